"""Readers and writers of keyed tables.

Numbers that are NaN are missing in the files these jobs read, so they become null on the way in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The feature columns, and the count of pay days that makes a chain active.
FEATURES = ["max_pay_day", "cv_pay_day", "std_pay_day", "quarter_avg_std"]
COUNT, LABEL, KEY = "chain_num_pay_day", "dis_index", "key"

INDEX_SCHEMA = T.StructType([T.StructField(KEY, T.StringType()), T.StructField(COUNT, T.LongType()), *(T.StructField(c, T.DoubleType()) for c in FEATURES)])
LABEL_SCHEMA = T.StructType([T.StructField(KEY, T.StringType()), T.StructField(LABEL, T.IntegerType())])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of every floating column as null."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in floats}) if floats else df


def _allow(spark: SparkSession, encoding: str) -> None:
    # Spark 4 reads and writes other than Unicode and Latin-1 text only with this setting
    if encoding.upper() not in ("UTF-8", "UTF-16", "ISO-8859-1", "US-ASCII"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_keyed_csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8") -> DataFrame:
    """A delimited table with header and an explicit schema; blank, unreadable and NaN numbers are null."""
    _allow(spark, encoding)
    return nan_to_null(spark.read.schema(schema).option("header", True).option("encoding", encoding).csv(path))


def write_keyed_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """A folder of delimited files with header."""
    _allow(df.sparkSession, encoding)
    df.write.mode("overwrite").option("header", True).option("encoding", encoding).csv(path)


def read_raw_csv(spark: SparkSession, path: str, key: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """A headerless delimited file, all strings: key, then numeric columns (null where not a number), then categories."""
    names = [key, *numeric, *categorical]
    raw = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    return raw.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in numeric}) if numeric else raw


def read_checked_csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8", header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of delimited files: a line is in the one or the other.

    A line is rejected if its fields are more or fewer than the schema's or a field that isn't blank can't be read as the column's type.
    rejects: file, line (its text), column and value of each reason; of a line with the wrong number of fields column and value are null.
    NaN is a number that is missing, not a reason. Both read the files, neither counts them.
    """
    _allow(spark, encoding)
    bad, names = "_line", [f"c{i}" for i in range(len(schema))]
    wide = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField(bad, T.StringType())])
    raw = spark.read.schema(wide).option("header", header).option("enforceSchema", True).option("encoding", encoding).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad)
    raw = raw.option("columnPruning", False).csv(path)  # a line read in part would not be seen to be wrong
    typed = {n: F.expr(f"try_cast(nullif(trim({n}), '') AS {f.dataType.simpleString()})") for n, f in zip(names, schema) if not isinstance(f.dataType, T.StringType)}
    wrong = [F.when(F.trim(n).isNotNull() & (F.trim(n) != "") & typed[n].isNull(), F.struct(F.lit(f.name).alias("column"), F.col(n).alias("value"))) for n, f in zip(names, schema) if n in typed]
    none = F.lit(None).cast("string")
    reasons = F.when(F.col(bad).isNotNull(), F.array(F.struct(none.alias("column"), none.alias("value")))).otherwise(F.array_compact(F.array(*wrong)) if wrong else F.array())
    line = F.coalesce(bad, F.concat_ws(",", *(F.coalesce(n, F.lit("")) for n in names)))
    told = raw.select(*names, F.col("_metadata.file_path").alias("file"), line.alias("line"), reasons.alias("reasons"))
    rows = told.where(F.size("reasons") == 0).select(*(typed.get(n, F.col(n)).alias(f.name) for n, f in zip(names, schema)))
    return nan_to_null(rows), told.where(F.size("reasons") > 0).select("file", "line", F.inline("reasons"))


def count_rejects(rejects: DataFrame) -> DataFrame:
    """(file, column, n): how many fields of a column, or lines with the wrong number of fields (column null), a file has that were rejected."""
    return rejects.groupBy("file", "column").agg(F.count("*").alias("n"))


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` as the table ``name``, dealt and sorted by ``key``: tables with as many buckets are aligned without an exchange."""
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)
