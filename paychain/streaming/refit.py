"""Refitting of scalers and landmarks while the rows of projects arrive.

A new project is scored with its own scaler and landmarks but fitted components, clusters or coefficients. Landmarks are
quantiles of linear combinations of the *scaled* features, and the scaler moves with every row, so a sketch of each
column can't be carried over. The state of a project is therefore a uniform sample of its rows: those with the least
hashes of key and values, a bounded number. It doesn't depend on the order or the batches in which rows arrive, and up to that number
of rows it is all of them, so that the refit equals one over the whole table.

Beyond it a quantile's rank is off by no more than ``rank_error``, a share of the rows, with 99 %
confidence (Dvoretzky, Kiefer and Wolfowitz). Tasks keep the least hashes of what they read before anything is
shuffled: of a project that has a third of all rows, a task sends no more than the sample.

``write_exact_refits`` keeps all rows as a table instead, and its refits are exact for any number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from paychain.jobs.classify_job import ClassifierState
from paychain.jobs.cluster_job import ClusterState
from paychain.operators.prep import active_rows, fill_missing
from paychain.operators.scale import QuantileMap, RobustParams, Whitening, group_quantiles, interpolated
from paychain.sources.scratch import settled
from paychain.sources.tables import COUNT, FEATURES, INDEX_SCHEMA, KEY, nan_to_null

#: Rows of a project that its state keeps, landmarks of a component at most, and one less the confidence of the stated error.
SAMPLE_ROWS, LANDMARKS, DOUBT = 1 << 14, 1000, 0.01
REFIT_SCHEMA = "project string, n long, kept long, rank_error double, low array<double>, median array<double>, high array<double>, landmarks array<array<double>>"
_ROWS = "project string, n long, h long, " + ", ".join(f"x{j} double" for j in range(len(FEATURES)))


def read_project_arrivals(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """New parquet files of feature tables with a column ``project`` as a stream, no more than ``files`` in a batch if that is given."""
    stream = spark.readStream.option("maxFilesPerTrigger", files) if files else spark.readStream
    return nan_to_null(stream.schema(StructType([*INDEX_SCHEMA, StructField("project", StringType())])).parquet(path))


def _least(h: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
    """Places of the rows with the least hashes; equal hashes go by the values, so what is kept depends on the rows alone."""
    if len(h) <= rows:
        return np.arange(len(h))
    return np.lexsort((*x.T[::-1], h))[:rows]


def refit_rows(h: np.ndarray, x: np.ndarray, whitening: Whitening | None) -> tuple[list[list[float]], list[list[float]]]:
    """(low, median and high of each feature; landmarks of each component) of some rows."""
    q = [interpolated(np.sort(c), [0.25, 0.5, 0.75]) or [0.0, 0.0, 0.0] for c in x.T]
    scaler = RobustParams(tuple(FEATURES), *(tuple(c[k] for c in q) for k in range(3)))
    marks = []
    if whitening is not None:
        scaled = [(c - scaler.median[j]) / scaler.scale(j) for j, c in enumerate(x.T)]
        n = max(2, min(LANDMARKS, len(x)))
        for line in whitening.rows:
            pc = np.zeros(len(x))
            for w, c, m in zip(line, scaled, whitening.mean):
                pc = pc + w * (c - m)
            marks.append(interpolated(np.sort(pc), [k / (n - 1) for k in range(n)]) or [0.0, 0.0])
    return [list(scaler.low), list(scaler.median), list(scaler.high)], marks


def refit_stream(arrivals: DataFrame, whitening: Whitening | None = None, sample: int = SAMPLE_ROWS) -> DataFrame:
    """For each project with new active rows, its refit over all rows so far: ``REFIT_SCHEMA``, in update mode.

    n counts the active rows of the project, kept those of its sample. Inactive rows change nothing. A null project is a project.
    Rows that repeat count again. landmarks are empty without ``whitening``.
    """
    d = len(FEATURES)
    rows = fill_missing(active_rows(arrivals, COUNT), FEATURES)
    rows = rows.select(F.col("project"), F.lit(1).cast("long").alias("n"), F.xxhash64(KEY, *FEATURES).alias("h"), *(F.col(c).alias(f"x{j}") for j, c in enumerate(FEATURES)))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            at = np.asarray(codes.indices.fill_null(-1))
            h, x = np.asarray(batch.column(2)), np.stack([np.asarray(c) for c in batch.columns[3:]], 1)
            for code in np.unique(at):
                name = None if code < 0 else codes.dictionary[int(code)].as_py()
                n, old_h, old_x = held.get(name, (0, np.zeros(0, np.int64), np.zeros((0, d))))
                here = at == code
                all_h, all_x = np.concatenate([old_h, h[here]]), np.concatenate([old_x, x[here]])
                keep = _least(all_h, all_x, sample)
                held[name] = (n + int(here.sum()), all_h[keep], all_x[keep])
        for name, (n, h, x) in held.items():
            counts = np.zeros(len(h), np.int64)
            counts[0] = n  # the first row tells of all that were read
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(counts), pa.array(h), *(pa.array(c) for c in x.T)], ["project", "n", "h", *(f"x{j}" for j in range(d))])

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, h, x = 0, np.zeros(0, np.int64), np.zeros((0, d))
        if state.exists:
            n, h, x = state.get
            h, x = np.frombuffer(h, np.int64), np.frombuffer(x).reshape(-1, d)
        for frame in frames:
            n += int(frame["n"].sum())
            h, x = np.concatenate([h, frame["h"].to_numpy(np.int64)]), np.concatenate([x, frame[[f"x{j}" for j in range(d)]].to_numpy(float)])
            keep = _least(h, x, sample)
            h, x = h[keep], x[keep]
        state.update((n, h.tobytes(), np.ascontiguousarray(x).tobytes()))
        (low, median, high), marks = refit_rows(h, x, whitening)
        error = 0.0 if n == len(h) else math.sqrt(math.log(2 / DOUBT) / (2 * len(h)))
        yield pd.DataFrame({"project": [key[0]], "n": [n], "kept": [len(h)], "rank_error": [error], "low": [low], "median": [median], "high": [high], "landmarks": [marks]})

    return rows.mapInArrow(thin, _ROWS).groupBy("project").applyInPandasWithState(update, REFIT_SCHEMA, "n long, h binary, x binary", "update", GroupStateTimeout.NoTimeout)


def write_refits(refits: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of each batch's refits under ``path``/batch=N; a batch that is run again is written over. The caller sets its trigger and starts it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return refits.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def _exact(rows: DataFrame, whitening: Whitening | None) -> DataFrame:
    """``REFIT_SCHEMA`` of each project over all of ``rows``."""
    quarters = group_quantiles(rows, "project", FEATURES, lambda n: [0.25, 0.5, 0.75])
    place = lambda k: F.array(*(F.coalesce(F.max(F.when(F.col("c") == j, F.get("q", F.lit(k)))), F.lit(0.0)) for j in range(len(FEATURES))))
    scalers = settled(quarters.groupBy("project").agg(*(place(k).alias(item) for k, item in enumerate(("low", "median", "high")))))
    told = rows.groupBy("project").agg(F.count("*").alias("n"))
    same = lambda a, b: a["project"].eqNullSafe(b["project"])
    found = told.join(scalers, same(told, scalers)).select(told["project"], "n", F.col("n").alias("kept"), F.lit(0.0).alias("rank_error"), "low", "median", "high")
    none = F.array().cast("array<array<double>>")
    if whitening is None:
        return found.withColumn("landmarks", none)
    get = lambda item, j: F.get(item, F.lit(j))
    scaled = [(F.col(c) - get("median", j)) / F.coalesce(F.nullif(get("high", j) - get("low", j), F.lit(0.0)), F.lit(1.0)) for j, c in enumerate(FEATURES)]
    pcs = [sum((F.lit(w) * (x - m) for w, x, m in zip(line, scaled, whitening.mean)), F.lit(0.0)).alias(f"pc{k}") for k, line in enumerate(whitening.rows)]
    white = rows.join(scalers, same(rows, scalers)).select(rows["project"], *pcs)

    def levels(n: int) -> list[float]:
        n = max(2, min(LANDMARKS, n))
        return [k / (n - 1) for k in range(n)]

    marks = group_quantiles(white, "project", [f"pc{k}" for k in range(len(pcs))], levels)
    marks = marks.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "q"))), lambda x: x["q"]).alias("landmarks"))
    return found.join(marks, same(found, marks), "left").select(found["*"], F.coalesce("landmarks", none).alias("landmarks"))


def write_exact_refits(arrivals: DataFrame, path: str, kept: str, checkpoint: str, whitening: Whitening | None = None) -> DataStreamWriter:
    """As ``write_refits``, of refits without error: all active rows stay in a table under ``kept``/batch=N, and of the projects with new
    rows exact quantiles are sought over all their rows so far, by ranges. The table is the state; it grows with the rows, no task holds a project.
    """
    rows = fill_missing(active_rows(arrivals, COUNT), FEATURES).select("project", *FEATURES)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{kept}/batch={number}")
        every = spark.read.schema(StructType([*batch.schema, StructField("batch", LongType())])).parquet(kept).where(F.col("batch") <= number)
        new = every.where(F.col("batch") == number).select(F.col("project").alias("_p")).distinct()
        known = settled(every.join(new, F.col("project").eqNullSafe(F.col("_p")), "left_semi").drop("batch"))
        _exact(known, whitening).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def latest_refits(spark: SparkSession, path: str) -> DataFrame:
    """The last refit of each project, and the ``batch`` that it is of."""
    found = spark.read.schema(f"{REFIT_SCHEMA}, batch long").parquet(path)
    return found.groupBy("project").agg(F.max_by(F.struct(*found.columns), "batch").alias("r")).select("r.*")


def refitted_state(refits: DataFrame, project: str | None, state: ClassifierState | ClusterState) -> ClassifierState | ClusterState:
    """``state`` with the scaler, and where there are clusters the landmarks, of a project's last refit."""
    row = refits.where(F.col("project").eqNullSafe(F.lit(project))).first()
    if row is None:
        raise ValueError(f"no refit of project {project}")
    scaler = RobustParams(tuple(FEATURES), tuple(row["low"]), tuple(row["median"]), tuple(row["high"]))
    if isinstance(state, ClassifierState):
        return replace(state, scaler=scaler)
    if len(row["landmarks"]) != len(state.quantiles.columns):
        raise ValueError("the refits have no landmarks of these components")
    return replace(state, scaler=scaler, quantiles=QuantileMap(state.quantiles.columns, tuple(tuple(line) for line in row["landmarks"])))
