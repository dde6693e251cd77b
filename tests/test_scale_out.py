"""Many columns, many centres, bucketed tables and dirty files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paychain.operators import cluster, prep, scale
from paychain.sources import tables


def test_whitening_of_many_columns(spark):
    g = np.random.default_rng(1)
    d, n = 1000, 1500
    x = g.normal(size=(n, 30)) @ g.normal(size=(30, d)) + 0.01 * g.normal(size=(n, d)) + 1e3 * np.arange(d)
    names = [f"v{j}" for j in range(d)]
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(key=np.arange(n))).repartition(3)
    w = scale.fit_whiten(df, names, 12)
    cov = np.cov(x.T)
    values, vectors = np.linalg.eigh(cov)
    assert np.allclose(w.variances, values[::-1][:12], rtol=1e-8) and np.allclose(w.mean, x.mean(0), rtol=1e-12)
    for row, value, v in zip(w.rows, values[::-1], vectors.T[::-1]):
        assert np.allclose(np.array(row) * np.sqrt(value), v * np.sign(v[np.abs(v).argmax()]), atol=1e-6)
    white = scale.apply_whiten(df, w)
    assert white.columns == [*names, "key", *(f"pc{k + 1}" for k in range(12))]
    got = np.array(white.orderBy("key").select(*(f"pc{k + 1}" for k in range(12))).collect())
    assert np.allclose(got, (x - x.mean(0)) @ np.array(w.rows).T, atol=1e-7) and np.allclose(np.cov(got.T), np.eye(12), atol=1e-6)


def test_wide_and_narrow_whitening_agree(spark, monkeypatch):
    rows = [(i, float(i % 7), float(i * i % 11), None if i == 5 else float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "key int, a double, b double, c double").repartition(4)
    full = df.where("c IS NOT NULL")
    narrow = scale.fit_whiten(full, ["a", "b", "c"], 5)
    monkeypatch.setattr(scale, "WIDE", 2)
    wide = scale.fit_whiten(df, ["a", "b", "c"], 5)  # leaves the row with a gap out
    assert np.allclose(wide.rows, narrow.rows) and np.allclose(wide.mean, narrow.mean)
    assert scale.apply_whiten(df, wide).where("pc1 IS NULL").select("key").collect() == [(5,)]
    assert scale.fit_whiten(df.limit(0), ["a", "b", "c"], 2).rows == ()


def test_many_centres(spark):
    g = np.random.default_rng(2)
    centres = [tuple(c) for c in g.normal(size=(2000, 3)).round(1)]  # with equal ones
    x = g.normal(size=(700, 3)).round(1)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(700, None, 0.0, 0.0)], "key int, a double, b double, c double")
    got = {r["key"]: r["predict_index"] for r in cluster.assign_nearest(df.withColumn("predict_index", F.lit("old")), ["a", "b", "c"], centres).collect()}
    far = sum((x[:, None, j] - np.array(centres)[None, :, j]) ** 2 for j in range(3))
    assert [got[i] for i in range(700)] == far.argmin(1).tolist() and got[700] is None
    few = cluster.assign_nearest(df, ["a", "b", "c"], centres[:20]).where("key < 700")
    assert [r["predict_index"] for r in few.orderBy("key").collect()] == far[:, :20].argmin(1).tolist()


def test_kmeans_starts(spark):
    g = np.random.default_rng(3)
    middle = g.normal(size=(6, 2)) * 20
    x = np.concatenate([m + g.normal(size=(60, 2)) for m in middle])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "key int, a double, b double").repartition(5)
    fit = cluster.fit_kmeans(df, ["a", "b"], 6, 10, key="key")
    again = cluster.fit_kmeans(df.repartition(2), ["a", "b"], 6, 10, key="key", sent=0)  # sums added up by an aggregation
    assert np.allclose(sorted(fit.centres), sorted((x[60 * i : 60 * i + 60].mean(0)).tolist() for i in range(6))) and np.allclose(fit.centres, again.centres)
    near = ((x[:, None] - np.array(fit.centres)[None]) ** 2).sum(-1)
    assert np.isclose(fit.cost, near.min(1).sum())
    one = cluster.fit_kmeans(df.where("key < 3").union(df.where("key < 3")), ["a", "b"], 6, 3, key="key")
    assert len(one.centres) == 3 and one.cost == 0  # three distinct rows
    for rows, what in ((df.where("key < 0"), "no rows"), (df.withColumn("a", F.when(F.col("key") > 3, F.col("a"))), "missing")):
        with pytest.raises(ValueError, match=what):
            cluster.fit_kmeans(rows, ["a", "b"], 2, 2)


def test_bucketed_tables_are_aligned_without_exchange(spark):
    features = spark.createDataFrame([(f"k{i}", float(i)) for i in range(200)] + [(None, 1.0)], "key string, x double")
    labels = spark.createDataFrame([(f"k{i}", i) for i in range(100, 300)], "key string, dis_index int")
    a, b = tables.write_bucketed(features, "bucketed_features", "key", 4), tables.write_bucketed(labels, "bucketed_labels", "key", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = prep.align_labels(a, b, "key")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        unique = a.groupBy("key").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in unique
        assert joined.count() == 301 and joined.exceptAll(prep.align_labels(features, labels, "key")).count() == 0
        with pytest.raises(ValueError, match="more than one row"):
            prep.align_labels(tables.write_bucketed(features.union(features.limit(1)), "bucketed_twice", "key", 4), b, "key")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("bucketed_features", "bucketed_labels", "bucketed_twice"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_dirty_files(spark, tmp_path):
    head = "key,chain_num_pay_day," + ",".join(tables.FEATURES) + "\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes((head + "链1,3,1.5,2,NaN,\n链2,three,1,x,1,1\n链3,2,1\n链4,,1e3, ,1,-2\n").encode("gbk"))
    (tmp_path / "in" / "b.csv").write_bytes((head + "链5,1,1,1,1,1,1\n链6,9223372036854775808,1,1,1,1\n链7,1,1,1,1,1\n").encode("gbk"))
    rows, rejects = tables.read_checked_csv(spark, str(tmp_path / "in"), tables.INDEX_SCHEMA, "GBK")
    assert rows.schema == tables.INDEX_SCHEMA
    assert sorted(map(tuple, rows.collect())) == [("链1", 3, 1.5, 2.0, None, None), ("链4", None, 1000.0, None, 1.0, -2.0), ("链7", 1, 1.0, 1.0, 1.0, 1.0)]
    got = sorted((r["file"][-5:], r["line"], r["column"] or "", r["value"]) for r in rejects.collect())
    assert got == [
        ("a.csv", "链2,three,1,x,1,1", "chain_num_pay_day", "three"), ("a.csv", "链2,three,1,x,1,1", "cv_pay_day", "x"), ("a.csv", "链3,2,1", "", None),
        ("b.csv", "链5,1,1,1,1,1,1", "", None), ("b.csv", "链6,9223372036854775808,1,1,1,1", "chain_num_pay_day", "9223372036854775808"),
    ]
    counts = {(r["file"][-5:], r["column"]): r["n"] for r in tables.count_rejects(rejects).collect()}
    assert counts == {("a.csv", "chain_num_pay_day"): 1, ("a.csv", "cv_pay_day"): 1, ("a.csv", None): 1, ("b.csv", None): 1, ("b.csv", "chain_num_pay_day"): 1}
    same = tables.read_keyed_csv(spark, str(tmp_path / "in"), tables.INDEX_SCHEMA, "GBK").where("key IN ('链1', '链4', '链7')")
    assert rows.exceptAll(same).count() == 0


def test_frequencies_by_moves_equal_those_of_all_rows(spark):
    g = np.random.default_rng(6)
    n = 900
    rows = [(i, float(g.normal(i % 3 * 4, 2)), "pqrst"[int(g.integers(5))] if i % 13 else None, int(g.integers(30)) - 15 if i % 17 else None, "one") for i in range(n)]
    df = spark.createDataFrame(rows, "key int, x double, a string, b int, c string").repartition(5)
    for numeric, cats in ((["x"], ["a", "b"]), ([], ["a", "b", "c"])):
        starts = cluster.cao_init(df, "key", cats, 4, numeric)
        by_moves = cluster.fit_prototypes(df, cats, starts, numeric)
        added_up = cluster.fit_prototypes(df.coalesce(2), cats, starts, numeric, sent=4 * 40)  # few may be sent: sums come from an aggregation
        whole = cluster.fit_prototypes(df, cats, starts, numeric, sent=0)
        for fit in (by_moves, added_up):
            assert np.allclose(fit.costs, whole.costs, rtol=1e-12) and len(fit.costs) == len(whole.costs)
            for mine, theirs in zip(fit.centres, whole.centres):
                assert mine[len(numeric) :] == theirs[len(numeric) :] and np.allclose(mine[: len(numeric)], theirs[: len(numeric)])
        assert by_moves.counted[0] == n and whole.counted == [] and (not numeric or len(whole.costs) > 3 and by_moves.counted[-1] < n / 4)
        for rounds in (1, 2, 3):  # each round's centres
            a, b = (cluster.fit_prototypes(df, cats, starts, numeric, max_iter=rounds, fixed=True, sent=s) for s in (cluster.SENT, 0))
            assert [x[len(numeric) :] for x in a.centres] == [x[len(numeric) :] for x in b.centres]
