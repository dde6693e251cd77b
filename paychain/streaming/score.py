"""Scoring of arriving chains with fitted state.

All fitted steps are narrow expressions over one row, so a stream is scored by the same functions as a
table; nothing is kept between batches and late rows need no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from paychain.jobs import classify_job, cluster_job
from paychain.sources.tables import INDEX_SCHEMA, nan_to_null


def read_arrivals(spark: SparkSession, path: str) -> DataFrame:
    """New parquet files of the feature table as a stream."""
    return nan_to_null(spark.readStream.schema(INDEX_SCHEMA).parquet(path))


def score_stream(arrivals: DataFrame, state: classify_job.ClassifierState | cluster_job.ClusterState) -> DataFrame:
    """The same project's scores of each active row."""
    if isinstance(state, cluster_job.ClusterState):
        return cluster_job.assign_project(arrivals, state)
    return classify_job.score_project(arrivals, state)


def write_scores(scores: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends to a parquet folder exactly once; the caller sets its trigger and starts it."""
    return scores.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
