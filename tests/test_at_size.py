"""What shows only in larger tables: frames, fits, sums and samples."""

import math
from datetime import datetime, timedelta
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql.types import StringType, StructField, StructType

from paychain.functions import curves
from paychain.jobs import queries
from paychain.operators import cluster
from paychain.operators.classify import fit_ovr, ovr_residuals
from paychain.operators.scale import Whitening
from paychain.sources import fixtures
from paychain.sources.tables import FEATURES, INDEX_SCHEMA
from paychain.streaming import refit


def test_macro_curve_goes_through_its_points_once(spark):
    """A frame that ends with the last row is gone through anew for each row."""
    r = np.random.default_rng(5)
    rows = [(int(c), int(r.random() < 0.4), float(r.normal())) for c in r.integers(1, 4, 600)]
    points = curves.roc_points(spark.createDataFrame(rows, "class int, truth int, score double"), ["class"])
    plan = curves.roc_macro(points, "class")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "window" in plan and "unboundedfollowing" not in plan


def test_each_class_against_the_rest_reaches_its_optimum(spark):
    """The more rows, the less the regularisation that the conditions are held against, and the earlier a tolerance of the cost stops."""
    r = np.random.default_rng(6)
    x = r.normal(size=(40_000, 3)) * [1.0, 4.0, 0.3]
    y = 1 + (x @ [1.0, 0.2, -0.5] + r.logistic(size=len(x)) > 0) + (x @ [0.5, 0.4, 0.5] + r.logistic(size=len(x)) > 2)
    df = spark.createDataFrame([(*map(float, row), int(c)) for row, c in zip(x, y)], "a double, b double, c double, y int").persist()
    found = ovr_residuals(df, fit_ovr(df, ["a", "b", "c"], "y"), "y").collect()
    df.unpersist()
    assert len(found) == 3 and all(row["residual"] < 1e-3 for row in found)


def test_exact_refits_beyond_the_sample(spark, tmp_path):
    """A project of more rows than a sample keeps; the null project gets rows in the first part alone."""
    r, n = np.random.default_rng(7), refit.SAMPLE_ROWS + 2000
    schema, source, out = StructType([*INDEX_SCHEMA, StructField("project", StringType())]), str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(str(i), int(i % 13 > 0), float(round(x[0])), None if i % 7 == 0 else float(x[1]), float(x[2]), float(x[3]), "hot" if i % 50 or i > n // 2 else None) for i, x in enumerate(r.normal(size=(n + 2000, 4)))]
    white = Whitening(tuple(FEATURES), (0.1, -0.2, 0.3, 0.0), (2.0, 1.0), ((0.5, -0.3, 0.2, 0.1), (0.1, 0.9, -0.4, 0.3)))
    for part in (rows[: n // 2 + 1], rows[n // 2 + 1 :]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        query = refit.write_exact_refits(refit.read_project_arrivals(spark, source), out, str(tmp_path / "kept"), str(tmp_path / "log"), white).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    got = {r["project"]: r for r in refit.latest_refits(spark, out).collect()}
    assert set(got) == {"hot", None} and got["hot"]["batch"] == 1 and got[None]["batch"] == 0
    for project, row in got.items():
        x = np.array([[v or 0.0 for v in q[2:6]] for q in rows if q[1] and q[6] == project])
        assert row["n"] == row["kept"] == len(x) and row["rank_error"] == 0
        (low, median, high), marks = refit.refit_rows(np.zeros(len(x), np.int64), x, white)
        assert np.allclose([row["low"], row["median"], row["high"]], [low, median, high], rtol=1e-12) and np.allclose(row["landmarks"], marks, rtol=1e-9, atol=1e-12)


def test_parts_of_a_stream_are_written_by_many_tasks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        path, parts = queries._arrivals(spark, "/root/testdata/sf0.01")
        for write in parts:
            write()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(spark.read.parquet(path).inputFiles()) > len(parts)


def test_equal_pay_days_give_equal_features_in_any_order(spark, tmp_path):
    """Two hundred chains of the same pay days, their rows shuffled: scores tie only if the features are equal to the last digit."""
    r, start = np.random.default_rng(8), datetime(1995, 1, 1)
    days = [int(d) for d in r.integers(1, 2000, 23)]
    lines = [(c * 100 + i, "R", "O", start + timedelta(days=d)) for c in range(200) for i, d in enumerate(days)]
    lines = [lines[i] for i in r.permutation(len(lines))]
    spark.createDataFrame(lines, "l_orderkey long, l_returnflag string, l_linestatus string, l_shipdate timestamp").repartition(7).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(c * 100 + i, c, start) for c in range(200) for i in range(len(days))], "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(c,) for c in range(200)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    found = fixtures.chain_features(spark, str(tmp_path)).drop("key").distinct().collect()
    assert len(found) == 1 and found[0]["std_pay_day"] == pytest.approx(np.std(days, ddof=1), rel=1e-14)


def test_attributes_without_values(spark):
    rows = spark.createDataFrame([(i, None, "ab"[i % 2]) for i in range(6)], "key int, a string, b string")
    fitted = cluster.fit_prototypes(rows, ["a", "b"], [("x", "a"), ("x", "b")])
    assert fitted.centres == [(None, "a"), (None, "b")]


def test_costs_are_right_to_the_last_digits(spark):
    """Sums that are rounded after each row drift by many units of the last digit, at size by cents."""
    i, gamma, centres = np.arange(300_000), 1e6 / 3, [(1234.5, "a"), (7000.25, "b")]
    x = (i * 7919 % 1_100_003) / 100 - 1000
    rows = spark.range(len(i), numPartitions=1).selectExpr("id * 7919 % 1100003 / 100D - 1000 AS x", "substr('abc', 1 + int(id % 3), 1) AS a")
    (cost,) = cluster.fit_prototypes(rows, ["a"], centres, ["x"], gamma, max_iter=1, fixed=True).costs
    paid = np.min([(x - c) ** 2 + gamma * (i % 3 != j) for j, (c, _) in enumerate(centres)], 0)
    assert abs(Fraction(cost) - sum(map(Fraction, paid.tolist()))) <= 2 * Fraction(math.ulp(cost))
