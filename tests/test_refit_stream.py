"""Refits on a stream against refits over the whole table."""

import random

import numpy as np
import pytest
from pyspark.sql.types import StringType, StructField, StructType

from paychain.jobs import cluster_job
from paychain.operators.classify import LinearModel
from paychain.operators.scale import QuantileMap, RobustParams, Whitening
from paychain.operators.cluster import KMeansFit
from paychain.jobs.classify_job import ClassifierState
from paychain.sources.tables import FEATURES, INDEX_SCHEMA, nan_to_null
from paychain.streaming import refit

N = len(FEATURES)
WHITE = Whitening(tuple(FEATURES), (0.1, -0.2, 0.3, 0.0), (2.0, 1.0), ((0.5, -0.3, 0.2, 0.1), (0.1, 0.9, -0.4, 0.3)))
STATE = cluster_job.ClusterState(RobustParams(tuple(FEATURES), (0.0,) * N, (0.0,) * N, (1.0,) * N), WHITE, QuantileMap(("pc1", "pc2"), ((0.0, 1.0),) * 2), KMeansFit(("pc1", "pc2"), [(0.2, 0.2), (0.8, 0.8)], 1.0))


def rows_of(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        project = r.choice(["hot", "hot", "hot", "small", None])
        x = [r.gauss(3 if project == "small" else 0, 1 + j) for j in range(N)]
        out.append((f"{seed}-{i}", 0 if i % 17 == 0 else None if i % 19 == 0 else 2, x[0], None if i % 7 == 0 else x[1], float("nan") if i % 11 == 0 else x[2], float(round(x[3])), project))
    return out + [out[0], out[1], out[1]]  # rows repeated


def run(spark, tmp_path, sample):
    """The rows arrive in three files and two runs of the stream, the second from the first one's checkpoint."""
    schema, parts = StructType([*INDEX_SCHEMA, StructField("project", StringType())]), [rows_of(s, n) for s, n in ((1, 300), (2, 500), (3, 40))]
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        if k != 1:
            stream = refit.refit_stream(refit.read_project_arrivals(spark, source), WHITE, sample)
            query = refit.write_refits(stream, out, log).trigger(availableNow=True).start()
            assert query.awaitTermination(120)
    table = nan_to_null(spark.createDataFrame([r for p in parts for r in p], schema))
    return refit.latest_refits(spark, out), table


def test_refits_equal_those_of_the_table(spark, tmp_path):
    latest, table = run(spark, tmp_path, refit.SAMPLE_ROWS)
    got = {r["project"]: r for r in latest.collect()}
    assert set(got) == {"hot", "small", None}
    for project in got:
        own = table.where("project IS NULL" if project is None else f"project = '{project}'")
        rows = cluster_job.project_rows(own)
        assert got[project]["n"] == got[project]["kept"] == rows.count() and got[project]["rank_error"] == 0
        mine, theirs = refit.refitted_state(latest, project, STATE), cluster_job.refit_state(rows, STATE)
        for item in ("low", "median", "high"):
            assert np.allclose(getattr(mine.scaler, item), getattr(theirs.scaler, item), rtol=1e-12)
        assert mine.whitening == theirs.whitening and mine.kmeans == theirs.kmeans
        for a, b in zip(mine.quantiles.landmarks, theirs.quantiles.landmarks, strict=True):
            assert np.allclose(a, b, rtol=1e-9, atol=1e-12)
    linear = ClassifierState(STATE.scaler, LinearModel(tuple(FEATURES), (1,), ((0.0,) * N,), (0.0,)), 1.0, 1)
    assert refit.refitted_state(latest, "hot", linear).scaler == refit.refitted_state(latest, "hot", STATE).scaler
    with pytest.raises(ValueError, match="no refit"):
        refit.refitted_state(latest, "other", STATE)


def test_samples_stay_within_the_stated_error(spark, tmp_path):
    latest, table = run(spark, tmp_path, 150)
    row = latest.where("project = 'hot'").first()
    x = np.array([[r[c] for c in FEATURES] for r in cluster_job.project_rows(table.where("project = 'hot'")).collect()])
    assert row["kept"] == 150 < row["n"] == len(x) and 0 < row["rank_error"] < 0.14
    for j in range(N):
        for level, item in ((0.25, "low"), (0.5, "median"), (0.75, "high")):
            below, upto = (x[:, j] < row[item][j]).mean(), (x[:, j] <= row[item][j]).mean()
            assert below - row["rank_error"] <= level <= upto + row["rank_error"]


def test_samples_depend_on_the_rows_alone():
    g = np.random.default_rng(0)
    h, x = g.integers(0, 50, 400), g.normal(size=(400, N)).round()
    whole = refit._least(h, x, 120)
    for cut in (1, 77, 399):
        parts = [np.arange(cut), np.arange(cut, 400)]
        some = np.concatenate([p[refit._least(h[p], x[p], 120)] for p in parts])
        again = some[refit._least(h[some], x[some], 120)]
        assert sorted(map(tuple, np.column_stack([h, x])[again])) == sorted(map(tuple, np.column_stack([h, x])[whole]))
