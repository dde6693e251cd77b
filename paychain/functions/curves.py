"""ROC curves of one-vs-rest scores as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paychain.sources.scratch import running_totals, settled


def long_scores(df: DataFrame, label: str, margins: list[str], classes: list[int]) -> DataFrame:
    """(class, truth, score): one row for each row and class."""
    pairs = F.array(*(F.struct(F.lit(c).alias("class"), (F.col(label) == c).cast("int").alias("truth"), F.col(m).alias("score")) for c, m in zip(classes, margins)))
    return df.where(F.col(label).isNotNull()).select(F.explode(pairs).alias("p")).select("p.*")


def roc_points(scores: DataFrame, by: list[str], bins: int | None = None) -> DataFrame:
    """(by.., score, fpr, tpr): one point for each distinct score from high to low, ties as one, and the origin (score null).

    Rows are counted by score, and the counts run in ranges of scores, so no task sees a whole curve. ``bins`` rounds scores
    to so many levels. Rates of a class without rows of one kind are null.
    """
    if bins:
        lo, hi = scores.agg(F.min("score"), F.max("score")).first()
        step = ((hi or 0.0) - (lo or 0.0)) / bins or 1.0
        scores = scores.withColumn("score", F.floor((F.col("score") - (lo or 0.0)) / step) * step + (lo or 0.0))
    counts = scores.groupBy(*by, "score").agg(F.sum("truth").alias("p"), F.sum(1 - F.col("truth")).alias("n"))
    run = running_totals(counts, by, [F.desc("score")], ["p", "n"])
    points = run.select(*by, "score", F.try_divide("upto_n", "all_n").alias("fpr"), F.try_divide("upto_p", "all_p").alias("tpr"))
    origin = run.groupBy(*by).agg(F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def auc(points: DataFrame, by: list[str]) -> DataFrame:
    """(by.., auc) by trapezoids: within ranges of a curve, and between the last point of a range and the first of the next."""
    names = [f"_b{i}" for i in range(len(by))]
    ranged = settled(points.select(*(F.col(c).alias(n) for c, n in zip(by, names)), "fpr", "tpr").repartitionByRange(*names, "fpr", "tpr").withColumn("_range", F.spark_partition_id()))
    point, within = F.struct("fpr", "tpr"), W.partitionBy("_range", *names).orderBy("fpr", "tpr")
    area = lambda a, b: (b["fpr"] - a["fpr"]) * (b["tpr"] + a["tpr"]) / 2
    inner = ranged.withColumn("part", area(F.lag(point).over(within), point)).select(*names, "part")
    ends = ranged.groupBy("_range", *names).agg(F.min(point).alias("first"), F.max(point).alias("last"))
    between = ends.withColumn("part", area(F.lag("last").over(W.partitionBy(*names).orderBy("_range")), F.col("first"))).select(*names, "part")
    return inner.unionByName(between).groupBy(*(F.col(n).alias(c) for c, n in zip(by, names))).agg(F.sum("part").alias("auc"))


def roc_macro(points: DataFrame, by: str) -> DataFrame:
    """(fpr, tpr): the mean over classes at every false-positive rate of any class, each curve interpolated between its points.

    A vertical step has two values; a rate right there takes the last. Classes without rates are left out. Each class's points
    and the rates of the others are sorted by ranges; a range gets the nearest points of the ranges around it. The next point
    is the last one seen from the other end: Spark goes through frames up to a row once, through those from a row on for each row.
    """
    known = settled(points.where("fpr IS NOT NULL AND tpr IS NOT NULL").withColumnRenamed(by, "class"))
    ends = known.groupBy("class", "fpr").agg(F.min("tpr").alias("low"), F.max("tpr").alias("high"))
    rates = known.select("fpr").distinct().crossJoin(F.broadcast(known.select("class").distinct()))  # a few classes
    rows = settled(rates.join(ends, ["class", "fpr"], "left").repartitionByRange("class", "fpr").withColumn("_range", F.spark_partition_id()))
    left, right = F.when(F.col("high").isNotNull(), F.struct("fpr", "high")), F.when(F.col("high").isNotNull(), F.struct("fpr", "low"))
    parts = rows.groupBy("_range", "class").agg(F.max(left).alias("last"), F.min(right).alias("first"))
    around = W.partitionBy("class")
    parts = parts.select(
        "_range", "class", *(F.last(c, True).over(around.orderBy(o).rowsBetween(W.unboundedPreceding, -1)).alias(n) for c, o, n in (("last", F.asc("_range"), "before"), ("first", F.desc("_range"), "after")))
    )
    within = W.partitionBy("_range", "class")
    near = rows.withColumns({"a": F.last(left, True).over(within.orderBy("fpr").rowsBetween(W.unboundedPreceding, 0)), "b": F.last(right, True).over(within.orderBy(F.desc("fpr")).rowsBetween(W.unboundedPreceding, -1))})
    near = near.join(parts, ["_range", "class"]).withColumns({"a": F.coalesce("a", "before"), "b": F.coalesce("b", "after")})
    slope = F.try_divide(F.col("b.low") - F.col("a.high"), F.col("b.fpr") - F.col("a.fpr"))
    tpr = F.coalesce("high", F.col("a.high") + (F.col("fpr") - F.col("a.fpr")) * slope, "a.high")
    return near.select("fpr", tpr.alias("tpr")).groupBy("fpr").agg(F.avg("tpr").alias("tpr"))
