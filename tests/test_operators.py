"""Hand-made edge cases; the queries' SQL is checked in test_queries.py."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paychain.functions import curves, metrics
from paychain.operators import cluster, prep, scale
from paychain.operators.classify import LinearModel, _newton, _train, fit_softmax_l1, kkt_residual, predict_linear
from paychain.sources import tables

nan = float("nan")


def test_nan_and_null_are_missing(spark):
    df = spark.createDataFrame([("a", 1, nan), ("b", 0, 1.0), ("c", None, 2.0), ("d", 3, None)], "key string, n int, x double")
    assert [r["key"] for r in prep.active_rows(df, "n").collect()] == ["a", "d"]
    assert {(r["column"], r["nan_num"]) for r in prep.null_profile(df, ["n", "x"]).collect()} == {("n", 1), ("x", 2)}
    assert [r["x"] for r in prep.model_input(df, "key", ["x"]).orderBy("key").collect()] == [0.0, 1.0, 2.0, 0.0]
    counted = df.withColumn("n", F.when(F.col("key") == "b", F.lit(nan)).otherwise(F.col("n")))
    assert [r["key"] for r in prep.active_rows(counted, "n").collect()] == ["a", "d"]


def test_repeated_key_is_an_error(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 3.0)], "key int, x double")
    with pytest.raises(ValueError, match="more than one row"):
        prep.align_labels(a, spark.createDataFrame([(1, 1)], "key int, y int"), "key")


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "key string, x double")
    assert prep.null_profile(df, ["x"], only_missing=False).first()["nan_num"] == 0


def test_stratified_split_sizes_and_repeatability(spark):
    df = spark.range(1003).select(F.col("id").alias("key"), F.when(F.col("id") < 3, 1).when(F.col("id") < 10, 2).otherwise(3).alias("y"))
    split = prep.stratified_split(df, "key", "y")
    got = {r["y"]: r["t"] for r in split.groupBy("y").agg(F.count_if("is_test").alias("t")).collect()}
    assert got == {1: 1, 2: 1, 3: (2 * 993 + 5) // 10} and split.count() == 1003
    assert {r["key"] for r in split.where("is_test").collect()} == {r["key"] for r in prep.stratified_split(df.repartition(7), "key", "y", buckets=4).where("is_test").collect()}


def test_robust_scale_of_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (3.0, 5.0, None), (10.0, 5.0, None)], "a double, b double, c double")
    p = scale.fit_robust(df, ["a", "b", "c"])
    assert p.median[0] == 2.5 and p.scale(1) == 1.0 and p.scale(2) == 1.0
    assert {r["b"] for r in scale.apply_robust(df, p).collect()} == {0.0}


def test_sketch_is_close_to_exact_quantiles(spark):
    df = spark.range(10001).select(F.col("id").cast("double").alias("x"))
    assert abs(scale.fit_robust(df, ["x"], exact=False).median[0] - 5000) <= 1


def test_quantile_map_of_ties_and_outside_values(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 0.0, 0.0, 1.0, 2.0]], "x double")
    m = scale.fit_quantiles(df, ["x"])
    got = scale.apply_quantiles(spark.createDataFrame([(0.0,), (-1.0,), (3.0,), (1.5,)], "x double"), m).collect()
    assert [round(r["x"], 6) for r in got] == [0.25, 0.0, 1.0, 0.875]


def test_whitening_leaves_out_what_has_no_variance(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i % 3)) for i in range(50)], "a double, b double, c double")
    w = scale.fit_whiten(df, ["a", "b", "c"], 5)
    assert len(w.rows) == 2
    row = scale.apply_whiten(df, w).agg(F.var_samp("pc1"), F.var_samp("pc2"), F.covar_samp("pc1", "pc2")).first()
    assert row[0] == pytest.approx(1) and row[1] == pytest.approx(1) and row[2] == pytest.approx(0, abs=1e-9)


def test_modes_ties_empty_cluster_and_falling_cost(spark):
    rows = spark.createDataFrame([(i, "xy"[i % 2], "pq"[i // 2 % 2]) for i in range(8)], "key int, a string, b string")
    fitted = cluster.fit_prototypes(rows, ["a", "b"], [("x", "p"), ("none", "none")])
    assert fitted.centres[1] == ("none", "none")  # kept without rows
    assert fitted.centres[0] == ("x", "p")  # the lowest of equally frequent values
    assert cluster.cao_init(rows, "key", ["a", "b"], 2)[0] == ("x", "p")
    kept = cluster.fit_kmodes(rows, "key", ["a", "b"], k=2, n_init=2)
    assert all(a > b for a, b in zip(kept.costs, kept.costs[1:]))


def test_prototypes_with_null_categories(spark):
    rows = spark.createDataFrame([(1, 1.0, None), (2, 1.0, "a"), (3, 9.0, "a")], "key int, x double, c string")
    fitted = cluster.fit_prototypes(rows, ["c"], cluster.cao_init(rows, "key", ["c"], 2, ["x"]), ["x"])
    assert cluster.assign_prototypes(rows, fitted).where("cluster IS NULL").count() == 0


def test_kmeans_nearest_and_project_again(spark):
    rows = spark.createDataFrame([(float(i % 2) * 10 + i / 100, 0.0) for i in range(40)], "a double, b double")
    fitted = cluster.fit_kmeans(rows, ["a", "b"], k=2, n_init=3)
    placed = cluster.assign_nearest(rows, ["a", "b"], fitted.centres)
    assert placed.groupBy("predict_index").count().count() == 2
    assert placed.exceptAll(cluster.assign_nearest(rows, ["a", "b"], fitted.centres)).count() == 0


def test_prediction_takes_the_first_of_equal_scores(spark):
    m = LinearModel(("x",), (1, 2, 3), ((1.0,), (1.0,), (0.0,)), (0.0, 0.0, 0.0))
    assert [r["predict_index"] for r in predict_linear(spark.createDataFrame([(1.0,), (-1.0,)], "x double"), m).collect()] == [1, 3]


def test_class_absent_from_predictions(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "y int, p int")
    report = {r["class"]: r for r in metrics.class_report(metrics.confusion(df, "y", "p", [1, 2, 3])).collect()}
    assert report[2]["precision"] == 0 and report[2]["recall"] == 0 and report[1]["precision"] == pytest.approx(1 / 3)
    assert metrics.score_summary(metrics.confusion(df, "y", "p", [1, 2, 3])).first()["accuracy"] == pytest.approx(1 / 3)


def test_equal_scores_are_one_roc_point(spark):
    s = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.5), (1, 1, 0.9), (1, 0, 0.1)], "class int, truth int, score double")
    points = curves.roc_points(s, ["class"])
    assert sorted((r["fpr"], r["tpr"]) for r in points.collect()) == [(0, 0), (0, 0.5), (0.5, 1), (1, 1)]
    assert curves.auc(points, ["class"]).first()["auc"] == pytest.approx(0.875)
    assert curves.auc(curves.roc_points(s, ["class"], bins=4), ["class"]).first()["auc"] == pytest.approx(0.875, abs=0.13)


def test_gbk_file_with_blank_and_nan_cells(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("key,chain_num_pay_day,max_pay_day,cv_pay_day,std_pay_day,quarter_avg_std\n甲,1,,NaN,nan,2\n".encode("gbk"))
    row = tables.read_keyed_csv(spark, str(tmp_path / "x.csv"), tables.INDEX_SCHEMA, "GBK").first()
    assert row["key"] == "甲" and row["quarter_avg_std"] == 2.0 and all(row[c] is None for c in ("max_pay_day", "cv_pay_day", "std_pay_day"))


def test_margin_losses(spark):
    df = spark.createDataFrame([(1, 2.0, 0.0), (2, 2.0, 0.0), (None, 0.0, 0.0)], "y int, m1 double, m2 double")
    row = metrics.losses(df, "y", ["m1", "m2"], [1, 2]).first()
    assert row["hinge_loss"] == pytest.approx(1.5) and row["log_loss"] == pytest.approx((2 * math.log(1 + math.exp(-2)) + 2) / 2)


def test_splits_keep_rows_without_key(spark):
    df = spark.createDataFrame([(i if i < 20 else None, 1) for i in range(22)], "key long, y int")
    rows = prep.stratified_split(df, "key", "y").collect()
    assert len(rows) == 22 and sum(r["is_test"] for r in rows) == 4
    assert all(r["is_test"] is not None for r in prep.random_split(df, "key").collect())


def test_quantiles_are_numpys(spark):
    import numpy as np

    r = np.random.default_rng(2)
    x, y = r.normal(0, 1, 3000).round(2), r.integers(0, 4, 3000).astype(float)
    df = spark.createDataFrame([(float(a), float(b) if i % 3 else None, None) for i, (a, b) in enumerate(zip(x, y))], "x double, y double, z double").repartition(5)
    levels = [k / 99 for k in range(100)]
    got = scale.quantiles(df, ["x", "y", "z"], levels)
    assert np.allclose(got[0], np.quantile(x, levels)) and np.allclose(got[1], np.quantile(y[np.arange(3000) % 3 > 0], levels)) and got[2] == []


def test_running_totals_over_many_ranges(spark):
    from paychain.sources.scratch import running_totals

    rows = [(i % 3 if i % 7 else None, i, (i * 31) % 17) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, x int, n long")
    want = {}
    for g, x, n in sorted(rows, key=lambda t: -t[1]):
        want.setdefault(g, []).append((x, n))
    for r in running_totals(df, ["g"], [F.desc("x")], ["n"]).collect():
        assert r["upto_n"] == sum(n for x, n in want[r["g"]] if x >= r["x"]) and r["all_n"] == sum(n for _, n in want[r["g"]])


def test_macro_curve_is_the_mean_of_interpolations(spark):
    import numpy as np

    r = np.random.default_rng(3)
    rows = [(int(c), int(r.random() < 0.4), float(round(r.normal(), 1))) for c in r.integers(1, 4, 900)]
    points = curves.roc_points(spark.createDataFrame(rows, "class int, truth int, score double"), ["class"])
    known = points.collect()
    got = {r["fpr"]: r["tpr"] for r in curves.roc_macro(points, "class").collect()}
    by = {c: sorted((p["fpr"], p["tpr"]) for p in known if p["class"] == c) for c in (1, 2, 3)}
    assert got.keys() == {p["fpr"] for p in known}
    for f, t in got.items():
        want = []
        for pts in by.values():
            at = [y for x, y in pts if x == f]
            want.append(max(at) if at else np.interp(f, [x for x, _ in pts], [y for _, y in pts]))
        assert abs(t - np.mean(want)) < 1e-9
    area = {r["class"]: r["auc"] for r in curves.auc(points, ["class"]).collect()}
    assert all(abs(area[c] - np.trapezoid([y for _, y in by[c]], [x for x, _ in by[c]])) < 1e-9 for c in by)


def test_prototypes_without_weight_gaps_and_rows(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (2, 0.0, "b"), (3, 9.0, "a"), (4, 9.0, "b")], "key int, x double, c string")
    p = cluster.fit_prototypes(df, ["c"], [(0.0, "a"), (9.0, "a")], ["x"], gamma=0.0)
    assert p.gamma == 0.0 and [r["cluster"] for r in cluster.assign_prototypes(df, p).orderBy("key").collect()] == [0, 0, 1, 1]
    gap = df.union(spark.createDataFrame([(5, None, "a")], df.schema))
    with pytest.raises(ValueError, match="missing numbers in x"):
        cluster.fit_prototypes(gap, ["c"], [(0.0, "a")], ["x"])
    with pytest.raises(ValueError, match="5 clusters"):
        cluster.huang_init(df, "key", ["c"], 5)
    with pytest.raises(ValueError, match="d has no values"):
        cluster.huang_init(df.withColumn("d", F.lit(None).cast("string")), "key", ["c", "d"], 2)


def test_huang_draws_follow_frequency_and_centres_are_rows(spark):
    rows = [(i, "b" if i % 10 == 0 else "a", f"v{i // 10 % 4}" if i % 3 else None) for i in range(300)]  # every pair of values occurs
    df = spark.createDataFrame(rows, "key int, c string, d string")
    starts = [cluster.huang_init(df, "key", ["c", "d"], 4, seed) for seed in range(12)]
    assert all(x in {r[1:] for r in rows} and x[1] is not None for s in starts for x in s)
    share = sum(x[0] == "a" for s in starts for x in s) / 48
    assert 0.75 < share < 1 and len(set(map(str, starts))) > 6
    assert cluster.huang_init(df.repartition(5), "key", ["c", "d"], 4, 3) == starts[3]


def test_modes_are_the_most_frequent_and_lowest_values(spark):
    rows = [(i, "b" if i % 2 else "a", None if i % 3 else "z") for i in range(8)]
    df = spark.createDataFrame(rows, "key int, c string, d string")
    assert cluster.fit_prototypes(df, ["c", "d"], [("a", "z")], max_iter=1, fixed=True).centres == [("a", "z")]
    nothing = df.withColumn("d", F.lit(None).cast("string"))
    assert cluster.fit_prototypes(nothing, ["c", "d"], [("b", None)], max_iter=1, fixed=True).centres == [("a", None)]


def test_newton_steps_reach_the_optimum(spark):
    """From a loose fit and from zeros; repeated rows, a constant column, empty partitions, large values. From far off no step may raise the cost."""
    r = np.random.default_rng(5)
    x = np.column_stack([r.normal(size=400), r.standard_cauchy(400) * 20, np.ones(400), r.normal(size=400) * 1e-3])
    y = np.where(r.random(400) < 0.2, r.integers(1, 4, 400), 1 + (x[:, 0] > 0) + (x[:, 0] + x[:, 3] > 1))
    rows = [(*map(float, v), int(k)) for v, k in zip(x, y)] * 2
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y int").repartition(5, "y")
    model, reg, n = fit_softmax_l1(df, cols, "y", tol=1e-1, steps=40)
    assert n == 800 and kkt_residual(df, model, "y", reg) < 1e-5
    data = _train(df, cols, "y", [1, 2, 3]).persist()

    def newton(weights, b, steps):
        weights, b = _newton(data, weights, b, reg, steps)
        return LinearModel(tuple(cols), (1, 2, 3), tuple(map(tuple, weights.tolist())), tuple(b.tolist()))

    other = newton(np.zeros((3, 4)), np.zeros(3), 40)
    assert kkt_residual(df, other, "y", reg) < 1e-5

    def cost(m):
        z = x @ np.array(m.weights).T + m.intercepts
        return np.mean(np.logaddexp.reduce(z, 1) - z[np.arange(400), y - 1]) + reg * np.abs(m.weights).sum()

    plain = fit_softmax_l1(df, cols, "y")[0]
    assert abs(cost(model) - cost(other)) < 1e-9 and cost(model) <= cost(plain) + 1e-12
    start = np.full((3, 4), 0.1) * [[3], [-2], [1]], np.array([5.0, -3.0, 0.0])
    assert cost(newton(*start, 2)) <= cost(newton(*start, 0))
    data.unpersist()
