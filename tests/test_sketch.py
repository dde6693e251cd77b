"""Merged day sketches against exact ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paychain.operators import scale, sketch


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.default_rng(5)
    day = np.where(np.arange(40_000) % 3 == 0, 0, g.integers(0, 9, 40_000))  # a third of all rows on one day
    x, y = g.lognormal(size=40_000), np.where(g.random(40_000) < 0.5, 7.0, np.round(g.normal(size=40_000) * 50))
    data = [(int(d) if d < 8 else None, float(a) if i % 10 else float("nan"), float(b) if i % 7 else None, None) for i, (d, a, b) in enumerate(zip(day, x, y))]
    return spark.createDataFrame(data, "day int, x double, y double, z double").repartition(7).persist()


def off(values, found, level):
    below, upto = (values < found).mean(), (values <= found).mean()
    return max(0.0, below - level, level - upto)


@pytest.mark.parametrize("k", [100, 1000])
def test_days_merge_within_the_bound(spark, tmp_path, rows, k):
    path = str(tmp_path / "days")
    sketch.write_days(sketch.day_sketches(rows.where("day < 4"), "day", ["x", "y", "z"], k), path)
    sketch.write_days(sketch.day_sketches(rows.where("day >= 4 OR day IS NULL"), "day", ["x", "y", "z"], k), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 3 * rows.select("day").distinct().count()
    levels = [i / 20 for i in range(21)]
    for some, days in ((rows, stored), (rows.where("day = 0"), stored.where("day = 0"))):
        merged = sketch.merge_sketches(days, k=k)
        assert {r["column"]: r["n"] for r in merged.collect()} == {c: some.where(f"{c} IS NOT NULL AND NOT isnan({c})").count() for c in ("x", "y", "z")}
        for c, found in zip("xyz", sketch.sketch_quantiles(merged, ["x", "y", "z"], levels)):
            values = np.array([r[0] for r in some.select(c).collect() if r[0] is not None and r[0] == r[0]])
            assert (c == "z") == (found == [])
            assert not found or max(off(values, f, q) for f, q in zip(found, levels)) <= sketch.rank_error(k)


def test_a_day_is_replaced(spark, tmp_path, rows):
    path = str(tmp_path / "days")
    sketch.write_days(sketch.day_sketches(rows.where("day < 3"), "day", ["x"]), path)
    sketch.write_days(sketch.day_sketches(rows.where("day = 1").limit(11).na.fill(1.0), "day", ["x"]), path)
    n = {r["day"]: r["n"] for r in spark.read.parquet(path).collect()}
    assert n[1] == 11 and set(n) == {0, 1, 2} and n[0] > 11


def test_fits_from_sketches(spark, rows):
    few = rows.where("day = 2").limit(900)
    few = spark.createDataFrame(few.collect(), few.schema)
    merged = sketch.merge_sketches(sketch.day_sketches(few, "day", ["x", "y", "z"]))
    mine, exact = sketch.fit_robust_merged(merged, ["x", "z"]), scale.fit_robust(few, ["x", "z"])
    values = np.sort([r["x"] for r in few.collect() if r["x"] is not None and r["x"] == r["x"]])
    step = np.diff(values).max()  # all values are kept: off by interpolation between neighbours alone
    for item in ("low", "median", "high"):
        assert abs(getattr(mine, item)[0] - getattr(exact, item)[0]) <= step and getattr(mine, item)[1] == 0.0
    marks = sketch.fit_quantiles_merged(merged, ["x", "z"], 50)
    assert len(marks.landmarks[0]) == 50 and marks.landmarks[0][0] == values[0] and marks.landmarks[0][-1] == values[-1] and marks.landmarks[1] == (0.0, 0.0)
    none = sketch.merge_sketches(sketch.day_sketches(few.where(F.lit(False)), "day", ["x"]))
    assert none.count() == 0 and sketch.fit_robust_merged(none, ["x"]).median == (0.0,)
