"""k-prototypes of a headerless file of symbol, number, category, category; also a spark-submit main.

    mixed_job.py STOCKS OUT
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from paychain.operators.cluster import assign_prototypes, cao_init, centre_table, fit_prototypes
from paychain.sources.scratch import settled
from paychain.sources.tables import read_raw_csv


def main(path: str, out: str, k: int = 4) -> None:
    spark = SparkSession.builder.appName("mixed clusters").getOrCreate()
    rows = read_raw_csv(spark, path, "symbol", ["market_cap"], ["sector", "country"]).where("market_cap IS NOT NULL").withColumn("key", F.xxhash64("symbol"))
    rows = settled(rows)
    fitted = fit_prototypes(rows, ["sector", "country"], cao_init(rows, "key", ["sector", "country"], k, ["market_cap"]), ["market_cap"])
    assign_prototypes(rows, fitted).select("symbol", "cluster").write.mode("overwrite").parquet(f"{out}/clusters")
    centre_table(spark, fitted).write.mode("overwrite").parquet(f"{out}/centroids")
    spark.createDataFrame([(i, c) for i, c in enumerate(fitted.costs)], "iteration int, cost double").write.mode("overwrite").parquet(f"{out}/cost")


if __name__ == "__main__":
    main(*sys.argv[1:])
