"""Alignment of features and labels, missing-value profile, active chains, model input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def missing(df: DataFrame, column: str) -> Column:
    """Null, or NaN in a floating column."""
    c = F.col(column)
    return c.isNull() | F.isnan(c) if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """``df``, or ValueError if a key repeats."""
    twice = df.groupBy(key).count().where("count > 1").select(key).first()
    if twice is not None:
        raise ValueError(f"key {twice[0]!r} is in more than one row")
    return df


def align_labels(features: DataFrame, labels: DataFrame, key: str, check: bool = True) -> DataFrame:
    """All keys of either side with the columns of both. With ``check``, a repeated key is an error and not a product of rows."""
    if check:
        features, labels = require_unique(features, key), require_unique(labels, key)
    return features.join(labels, key, "full_outer")


def null_profile(df: DataFrame, columns: list[str], only_missing: bool = True) -> DataFrame:
    """(column, nan_num, nan_pct): how often each column is missing, counted in one pass."""
    one = df.agg(F.count("*").alias("n"), *(F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(columns)))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("nan_num")) for i, c in enumerate(columns))))
    out = one.select("n", rows.alias("r")).select("r.column", "r.nan_num", F.try_divide("r.nan_num", "n").alias("nan_pct"))
    return out.where("nan_pct > 0") if only_missing else out


def active_rows(df: DataFrame, count: str, least: int = 1) -> DataFrame:
    """Rows whose count is known and at least ``least``; Spark ranks NaN above every number, here it is missing."""
    return df.where((F.col(count) >= least) & ~missing(df, count))


def fill_missing(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    return df.na.fill(value, columns)


def model_input(df: DataFrame, key: str, features: list[str], label: str | None = None) -> DataFrame:
    return fill_missing(df.select(key, *features, *([label] if label else [])), features)


def split_labelled(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows with and rows without a label."""
    return df.na.drop(subset=[label]), df.where(missing(df, label))


def _as_text(key: str) -> Column:
    """The key for a digest; rows without a key are drawn alike."""
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def stratified_split(df: DataFrame, key: str, label: str, test: float = 0.2, seed: int = 0, buckets: int = 4096) -> DataFrame:
    """``df`` with ``is_test``: in each class the first share of rows by md5(key|seed), rounded half up.

    Rows are counted by class and hash bucket; only the bucket in which a class's cut falls is ranked row by row, so a
    class that holds most rows is not sorted in one task. A null key counts as the empty text, a null label is a class.
    """
    from pyspark.sql import Window as W

    digest = F.md5(F.concat(_as_text(key), F.lit(f"|{seed}")))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * buckets / (1 << 32)
    rows = df.withColumns({"_h": digest, "_b": F.floor(bucket).cast("int")})
    counts = rows.groupBy(label, "_b").agg(F.count("*").alias("n"))
    upto = W.partitionBy(label).orderBy("_b")  # buckets, not rows
    share = round(test * 1_000_000)
    cuts = counts.select(
        F.col(label).alias("_l"), F.col("_b").alias("_cut"), F.col("n"), F.sum("n").over(upto).alias("upto"), ((F.sum("n").over(W.partitionBy(label)) * share * 2 + 1_000_000) / 2_000_000).cast("long").alias("want")
    ).where("upto - n <= want AND want < upto")
    cuts = cuts.select("_l", "_cut", (F.col("want") - F.col("upto") + F.col("n")).alias("_left"))  # one row for each class
    joined = rows.join(cuts, F.col(label).eqNullSafe(F.col("_l")), "left")
    edge = joined.where("_b = _cut").withColumn("_r", F.row_number().over(W.partitionBy(label).orderBy("_h", key))).withColumn("is_test", F.col("_r") <= F.col("_left"))
    rest = joined.where("_cut IS NULL OR _b <> _cut").withColumn("is_test", F.coalesce(F.col("_b") < F.col("_cut"), F.lit(True)))
    return edge.select(*df.columns, "is_test").unionByName(rest.select(*df.columns, "is_test"))


def random_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 0) -> DataFrame:
    """``df`` with ``is_test`` by a threshold on md5(key|seed), a null key as the empty text; the same rows in every run and engine."""
    draw = F.conv(F.substring(F.md5(F.concat(_as_text(key), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("long")
    return df.withColumn("is_test", draw < int(test * (1 << 32)))
