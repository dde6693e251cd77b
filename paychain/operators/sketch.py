"""Quantiles from stored sketches: one for each day and column, merged when they are needed.

The sketches are KLL sketches of Spark's own, kept as a table of (day, column, n, sketch). Tasks sketch what they read and
sketches are merged, so a day is one aggregation with small partial results, whatever its size. A later day adds its rows
to the table; none is read again. A quantile's rank is off by no more than ``rank_error(k)``, a share of the rows, with 99 %
confidence, however many days are merged. Sketches of no more than about ``k`` values hold all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paychain.operators.scale import QuantileMap, RobustParams

#: Size of a sketch: values kept at the bottom level (8 to 65535); a sketch has some three times as many in all.
K = 4096


def rank_error(k: int = K) -> float:
    """The stated bound of the rank's error, as a share of the rows."""
    return 2.296 / k**0.9723


def _value(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def day_sketches(df: DataFrame, day: str, columns: list[str], k: int = K) -> DataFrame:
    """(day, column, n, sketch) of the values of each column and day; NaN and null are left out, n counts the rest.

    Columns that are missing on a whole day have n 0 and no sketch. Rows without a day have the day null.
    """
    sketches = [F.kll_sketch_agg_double(F.when(_value(c).isNotNull(), _value(c)), k).alias(f"s{i}") for i, c in enumerate(columns)]
    found = df.groupBy(F.col(day).alias("day")).agg(*(F.count(_value(c)).alias(f"n{i}") for i, c in enumerate(columns)), *sketches)
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.when(F.col(f"n{i}") > 0, F.col(f"s{i}")).alias("sketch")) for i, c in enumerate(columns))))
    return found.select("day", rows.alias("r")).select("day", "r.*")


def write_days(sketches: DataFrame, path: str) -> None:
    """Write the sketches of some days; what was stored of these days is replaced, other days stay."""
    sketches.repartition(1, "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def merge_sketches(sketches: DataFrame, by: list[str] | None = None, k: int = K) -> DataFrame:
    """(column, n, sketch), and the columns ``by``, over all the rows of a table of sketches, merged as they come."""
    return sketches.groupBy(*(by or []), "column").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantiles(merged: DataFrame, columns: list[str], levels: list[float]) -> list[list[float]]:
    """The quantiles of each column from merged sketches, values of the data; an empty list for a column without values."""
    at = F.array(*map(F.lit, levels))
    rows = merged.where((F.col("n") > 0) & F.col("column").isin(columns)).select("column", F.kll_sketch_get_quantile_double("sketch", at).alias("q")).collect()  # a row for each column
    found = {r["column"]: list(r["q"]) for r in rows}
    return [found.get(c, []) for c in columns]


def fit_robust_merged(merged: DataFrame, columns: list[str]) -> RobustParams:
    """Quartiles and median from merged sketches; a column without values scales by 1 around 0."""
    q = [x or [0.0, 0.0, 0.0] for x in sketch_quantiles(merged, columns, [0.25, 0.5, 0.75])]
    return RobustParams(tuple(columns), *(tuple(x[i] for x in q) for i in range(3)))


def fit_quantiles_merged(merged: DataFrame, columns: list[str], n: int = 1000) -> QuantileMap:
    """Up to ``n`` landmarks of each column from merged sketches, no more than the column with most values has."""
    most = merged.where(F.col("column").isin(columns)).agg(F.max("n")).first()[0] or 0
    n = max(2, min(n, most))
    return QuantileMap(tuple(columns), tuple(tuple(x) or (0.0, 0.0) for x in sketch_quantiles(merged, columns, [i / (n - 1) for i in range(n)])))
