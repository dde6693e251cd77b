"""What the operators share: shared-folder tables and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none and runs on one machine (tests), a temporary folder of this process.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="paychain-shared-"))
    return _OWN_DIR[0]


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that ``materialize`` returned and nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._paychain_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result has no lineage, so a lost executor costs a re-read and not a recomputation.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._paychain_path = path
    return out


def reread(parts: list[DataFrame]) -> DataFrame:
    """The rows of frames of equal columns that ``materialize`` returned, in one scan however many they are."""
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*(p._paychain_path for p in parts))


def blobs(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


#: Bytes of batches that are held for one call, about, however few rows they are.
HELD_BYTES = 64 << 20
#: Rows of a batch between the JVM and Python: whole texts are long, and each running task holds some batches on both sides.
BATCH_ROWS = 1024
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let the session pass no more than ``BATCH_ROWS`` rows at a time to Python; a smaller setting stays."""
    if not 0 < int(spark.conf.get(_ROWS_SETTING)) <= BATCH_ROWS:
        spark.conf.set(_ROWS_SETTING, str(BATCH_ROWS))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 1) -> DataFrame:
    """One output batch for each input batch, or for as many as have ``rows`` rows or ``HELD_BYTES`` bytes."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            held += [batch] if batch is not None and batch.num_rows else []
            if held and (batch is None or sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= HELD_BYTES):
                out = fn(held[0] if len(held) == 1 else pa.concat_batches(held))
                held = []
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


#: A group that may hold a third of all rows is joined in so many parts.
PARTS = 16


def part_of(*spread: str) -> Column:
    """The part of its group that a row is in, by a hash of ``spread``."""
    return F.pmod(F.xxhash64(*spread), F.lit(PARTS)).cast("int")


def parts_held(part: Column) -> Column:
    """Aggregate: the parts that a group has, as bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1), part))


def each_part(held: Column) -> Column:
    """One row for each of the parts held, so that what is known of a group is repeated only for parts that it has."""
    every = F.sequence(F.lit(0), F.lit(PARTS - 1))
    return F.explode(F.filter(every, lambda p: F.call_function("shiftright", held, p).bitwiseAND(F.lit(1)) == 1))


def with_group_min(df: DataFrame, by: str, value: str, name: str, *spread: str) -> DataFrame:
    """``df`` and, as ``name``, the least ``value`` of the rows that are equal in ``by`` (not null), joined in parts."""
    dealt = df.withColumn("_part", part_of(*spread))
    found = dealt.groupBy(by).agg(F.min(value).alias(name), parts_held(F.col("_part")).alias("_held"))
    return dealt.join(found.select(by, name, each_part(F.col("_held")).alias("_part")), [by, "_part"]).drop("_part")


def crc_remainder(key: str, n: int):
    """crc32 of the key as text, modulo ``n``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def with_columns(
    docs: DataFrame, keep: list[str], text: str, fn: Callable[[list[bytes | None], pa.RecordBatch], list], added: str, names: list[str], rows: int = 1
) -> DataFrame:
    """``keep`` columns of ``docs`` and those that ``fn`` makes from the texts of a batch.

    A kept column whose name a new one takes is left out.
    """
    keep = [c for c in keep if c.lower() not in {n.lower() for n in names}]
    kept = [docs[f"`{c}`"] for c in keep]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), added])
    n, at = len(keep), keep.index(text) if text in keep else len(keep)  # the text goes to Python once

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:n], *fn(blobs(batch.column(at)), batch)], [*keep, *names])

    inner = docs.select(*(c.alias(f"_k{i}") for i, c in enumerate(kept)), *([docs[f"`{text}`"].alias("_text")] if at == n else []))
    return map_batches(inner, one, schema, rows)


def cut_spans(docs: DataFrame, text: str, spans: str, filler: str) -> DataFrame:
    """``docs`` with the code-point ``spans`` (structs with start and end) of the text replaced by ``filler``; spans may overlap."""
    from pyspark.sql import types as T

    names = docs.columns
    at, where = names.index(text), names.index(spans)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, found = batch.column(at).to_pylist(), batch.column(where).to_pylist()
        for i, got in enumerate(found):
            if got:
                out, done, t = [], 0, texts[i]
                for s, e in sorted((x["start"], x["end"]) for x in got):
                    if e > done:
                        out += [t[done : max(s, done)], filler] if s >= done else []
                        done = e
                texts[i] = "".join([*out, t[done:]])
        cols = list(batch.columns)
        cols[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(cols, names)

    return map_batches(docs, one, T.StructType(docs.schema.fields))
