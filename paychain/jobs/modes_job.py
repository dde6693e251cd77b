"""k-modes of a headerless file of key and categories; also a spark-submit main.

    modes_job.py CATEGORIES OUT COLUMNS [k] [starts]
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from paychain.operators.cluster import assign_prototypes, centre_table, fit_kmodes
from paychain.sources.scratch import settled
from paychain.sources.tables import read_raw_csv


def main(path: str, out: str, columns: str, k: str = "4", starts: str = "5") -> None:
    """``columns`` has the number of categories of a row; the best of ``starts`` Huang starts."""
    spark = SparkSession.builder.appName("category clusters").getOrCreate()
    names = [f"a{i}" for i in range(int(columns))]
    rows = settled(read_raw_csv(spark, path, "name", [], names).withColumn("key", F.xxhash64("name")))
    fitted = fit_kmodes(rows, "key", names, int(k), n_init=int(starts))
    assign_prototypes(rows, fitted).select("name", "cluster").write.mode("overwrite").parquet(f"{out}/clusters")
    centre_table(spark, fitted).write.mode("overwrite").parquet(f"{out}/centroids")


if __name__ == "__main__":
    main(*sys.argv[1:])
