"""A folder that driver and executors share, for intermediate files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_OWN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; under a temporary folder where the session names none and runs on one machine."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="paychain-"))
        top = _OWN[0]
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written as a table and read again: iterative fits then neither plan nor compute what leads to it once more."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_totals(df: DataFrame, by: list[str], order: list[Column], sums: list[str]) -> DataFrame:
    """``df`` with ``upto_x`` and ``all_x`` for each x of ``sums``: its total up to and with a row, and over all rows, of equal ``by``.

    ``order`` makes rows of equal ``by`` distinct. Spark cuts the order into ranges; totals run within a range and the
    ranges' sums, a row for each, are added. No task sees more than a range, however many rows are equal in ``by``.
    """
    names = [f"_b{i}" for i in range(len(by))]
    ranged = settled(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    parts = ranged.groupBy("_range", *(F.col(c).alias(n) for c, n in zip(by, names))).agg(*(F.sum(x).alias(x) for x in sums))
    before, whole = W.partitionBy(*names).orderBy("_range").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*names)
    parts = parts.select(
        F.col("_range").alias("_r"), *names, *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"_before_{x}") for x in sums), *(F.sum(x).over(whole).alias(f"all_{x}") for x in sums)
    )
    same = F.col("_range") == F.col("_r")
    for c, n in zip(by, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    within = W.partitionBy("_range", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    run = ranged.withColumns({f"upto_{x}": F.sum(x).over(within) for x in sums})
    return run.join(parts, same).select(*df.columns, *((F.col(f"upto_{x}") + F.col(f"_before_{x}")).alias(f"upto_{x}") for x in sums), *(f"all_{x}" for x in sums))
