"""Evaluation of predictions; everything but the losses is computed from the confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, expected: str, predicted: str, classes: list[int]) -> DataFrame:
    """(expected, predicted, n) for every pair of classes, 0 where none; one aggregation with map-side combine."""
    both = F.array(*(F.struct(F.lit(a).alias("expected"), F.lit(b).alias("predicted"), F.count_if((F.col(expected) == a) & (F.col(predicted) == b)).alias("n")) for a in classes for b in classes))
    return df.agg(both.alias("cells")).select(F.inline("cells"))


def class_report(counts: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) of a confusion table; a ratio without cases is 0."""
    hit = F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = counts.select(F.explode(F.array(F.struct(F.col("expected").alias("class"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"), hit.alias("t")), F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("t")))).alias("r")).select("r.*")
    r = sides.groupBy("class").agg(F.sum("s").alias("support"), F.sum("p").alias("called"), F.sum("t").alias("t"))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    return r.select("class", ratio(F.col("t"), F.col("called")).alias("precision"), ratio(F.col("t"), F.col("support")).alias("recall"), ratio(2 * F.col("t"), F.col("called") + F.col("support")).alias("f1"), "support", F.col("t").alias("hits"), "called")


def score_summary(counts: DataFrame) -> DataFrame:
    """One row: accuracy, macro and weighted F1, precision, recall and Jaccard, zero-one and Hamming loss."""
    r = class_report(counts)
    n = F.sum("support")
    union = F.col("support") + F.col("called") - F.col("hits")
    jaccard = F.when(union == 0, F.lit(0.0)).otherwise(F.col("hits") / union)
    right = F.try_divide(F.sum("hits"), n)  # null without rows
    out = [right.alias("accuracy")]
    for name, c in (("f1", F.col("f1")), ("precision", F.col("precision")), ("recall", F.col("recall")), ("jaccard", jaccard)):
        out += [F.avg(c).alias(f"{name}_macro"), F.try_divide(F.sum(c * F.col("support")), n).alias(f"{name}_weighted")]
    return r.agg(*out, (1 - right).alias("zero_one_loss"), (1 - right).alias("hamming_loss"))


def losses(df: DataFrame, label: str, margins: list[str], classes: list[int], floor: float = 1e-15) -> DataFrame:
    """One row: log loss of the softmax of the margins and multiclass hinge loss of the raw margins."""
    m = F.array(*(F.col(c) for c in margins))
    place = F.array_position(F.array(*map(F.lit, classes)), F.col(label)).cast("int")
    own = F.element_at(m, place)
    top = F.array_max(m)
    total = F.aggregate(m, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    others = F.array_max(F.filter(m, lambda x, i: i + 1 != place))
    return df.where(F.col(label).isNotNull()).agg(
        F.avg(-F.log(F.greatest(F.exp(own - top) / total, F.lit(floor)))).alias("log_loss"), F.avg(F.greatest(F.lit(0.0), 1 - (own - others))).alias("hinge_loss")
    )


def indicators(df: DataFrame, label: str, classes: list[int], prefix: str = "is_") -> DataFrame:
    """One 0/1 column for each class."""
    return df.withColumns({f"{prefix}{c}": (F.col(label) == c).cast("int") for c in classes})


def multilabel_scores(df: DataFrame, truth: list[Column], called: list[Column]) -> DataFrame:
    """One row over indicator rows: subset accuracy, mean Jaccard (1 where both are empty), bit error."""
    same = [(a == b).cast("int") for a, b in zip(truth, called)]
    both = sum((a * b for a, b in zip(truth, called)), F.lit(0))
    either = sum((F.greatest(a, b) for a, b in zip(truth, called)), F.lit(0))
    right = sum(same, F.lit(0))
    return df.agg(
        F.avg((right == len(truth)).cast("int")).alias("subset_accuracy"), F.avg(F.when(either == 0, F.lit(1.0)).otherwise(both / either)).alias("jaccard_samples"), F.avg(1 - right / len(truth)).alias("bit_error")
    )
