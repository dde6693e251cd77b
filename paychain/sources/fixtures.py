"""The inputs of the jobs, derived from the star-schema tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paychain.sources.tables import COUNT, KEY, LABEL


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(values: Column) -> Column:
    """The standard deviation (n - 1) of an array's numbers, added in its order; 0 of equal ones."""
    first, n, added = F.get(values, F.lit(0)), F.size(values), lambda a, x: a + x
    mean = first + F.aggregate(F.transform(values, lambda x: x - first), F.lit(0.0), added) / n
    return F.sqrt(F.aggregate(F.transform(values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), added) / (n - 1))


def chain_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pay-day features of every customer: a pay event is a returned line, its pay days run from order to shipment."""
    lines = _read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linestatus = 'O'").select("l_orderkey", "l_shipdate")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    days = F.datediff("l_shipdate", "o_orderdate").cast("double")
    events = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    # quarters first: sums that both levels of the features need
    quarters = events.groupBy("o_custkey", F.trunc("l_shipdate", "quarter").alias("q")).agg(
        F.count("*").alias("n"), F.sum(days).alias("s"), F.sum(days * days).alias("ss"), F.max(days).alias("m"), F.avg(days).alias("quarter_avg")
    )
    n, s = F.sum("n"), F.sum("s")
    # whole numbers up to the one division, and quarters in the order of their values: chains of equal pay days get equal features, in whatever order their rows come
    spread = F.when(n > 1, F.sqrt((n * F.sum("ss") - s * s) / (n * (n - 1))))
    chains = quarters.groupBy("o_custkey").agg(
        n.alias(COUNT), F.max("m").alias("max_pay_day"), spread.alias("std_pay_day"), (s / n).alias("mean"), F.array_sort(F.collect_list("quarter_avg")).alias("avgs")
    )
    chains = chains.withColumn("quarter_avg_std", F.when(F.size("avgs") > 1, _spread(F.col("avgs"))))
    keys = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias(KEY))
    return keys.join(chains, F.col(KEY) == F.col("o_custkey"), "left").select(
        KEY, F.coalesce(COUNT, F.lit(0)).cast("long").alias(COUNT), "max_pay_day", (F.col("std_pay_day") / F.nullif("mean", F.lit(0.0))).alias("cv_pay_day"), "std_pay_day", "quarter_avg_std"
    )


def chain_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_features(spark, sf_dir).where(F.col(KEY) % 11 != 0)


def chain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = F.coalesce("max_pay_day", F.lit(0.0))
    label = F.when(F.col(KEY) % 7 == 0, 1 + F.col(KEY) % 3).when(most < 1113, 1).when(most < 1648, 2).otherwise(3).cast("int")
    return chain_features(spark, sf_dir).where(F.col(KEY) % 5 != 0).select(KEY, label.alias(LABEL))


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = F.broadcast(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows
    return _read(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("symbol"), F.col("c_acctbal").cast("double").alias("market_cap"), F.col("c_mktsegment").alias("sector"), F.col("n_name").alias("country")
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"))


#: Common tables of every query's SQL.
PRELUDE = """
WITH events_ AS (
  SELECT o_custkey, date_trunc('quarter', l_shipdate) AS q, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_linestatus = 'O' AND l_shipdate >= o_orderdate),
quarters_ AS (SELECT o_custkey, q, avg(d) AS a FROM events_ GROUP BY ALL),
by_quarter_ AS (SELECT o_custkey, stddev_samp(a) AS quarter_avg_std FROM quarters_ GROUP BY ALL),
by_chain_ AS (SELECT o_custkey, count(*) AS n, max(d) AS max_pay_day, stddev_samp(d) AS std_pay_day, avg(d) AS mean FROM events_ GROUP BY ALL),
features_ AS (
  SELECT c_custkey AS key, coalesce(n, 0)::BIGINT AS chain_num_pay_day, max_pay_day, std_pay_day / nullif(mean, 0) AS cv_pay_day, std_pay_day, quarter_avg_std
  FROM customer LEFT JOIN by_chain_ b ON c_custkey = b.o_custkey LEFT JOIN by_quarter_ q ON c_custkey = q.o_custkey),
idx AS (SELECT * FROM features_ WHERE key % 11 <> 0),
labels_ AS (SELECT key, (CASE WHEN key % 7 = 0 THEN 1 + key % 3 WHEN coalesce(max_pay_day, 0) < 1113 THEN 1 WHEN coalesce(max_pay_day, 0) < 1648 THEN 2 ELSE 3 END)::INT AS dis_index
  FROM features_ WHERE key % 5 <> 0),
aligned AS (SELECT coalesce(i.key, l.key) AS key, i.chain_num_pay_day, i.max_pay_day, i.cv_pay_day, i.std_pay_day, i.quarter_avg_std, l.dis_index
  FROM idx i FULL JOIN labels_ l ON i.key = l.key),
active AS (SELECT * FROM aligned WHERE chain_num_pay_day >= 1),
model AS (SELECT key, coalesce(max_pay_day, 0) AS max_pay_day, coalesce(cv_pay_day, 0) AS cv_pay_day, coalesce(std_pay_day, 0) AS std_pay_day,
  coalesce(quarter_avg_std, 0) AS quarter_avg_std, dis_index FROM active),
stocks_ AS (SELECT c_custkey AS key, c_name AS symbol, c_acctbal::DOUBLE AS market_cap, c_mktsegment AS sector, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""
