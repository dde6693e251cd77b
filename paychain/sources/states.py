"""Versioned tables of fitted state.

A state is a small table of numbers, one row each. A version is written in two steps: the table under a new name, then a
marker file that names it, moved to ``versions/N`` by a rename that fails where N is there already. Readers look at markers
only, so they never see half a version, and of two writers one gets the next number. Versions are never changed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: kind: what was fitted; part and item: of what; i and j: the place in a vector or matrix; name: the column that a number is of.
STATE_SCHEMA = "kind string, part string, item string, i int, j int, name string, value double"
Row = tuple[str, str, str, int, int, str | None, float]


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions there are, oldest first; none where nothing was saved."""
    folder, fs = _files(spark, f"{path}/versions")
    if not fs.exists(folder):
        return []
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit())


def save_state(spark: SparkSession, path: str, rows: Iterable[Row]) -> int:
    """Write the numbers of a state as the next version and return its number."""
    name = f"state-{uuid.uuid4().hex}"
    spark.createDataFrame([(*r[:6], float(r[6])) for r in rows], STATE_SCHEMA).coalesce(1).write.parquet(f"{path}/{name}")
    jvm = spark._jvm
    draft, fs = _files(spark, f"{path}/versions/.{name}")
    out = fs.create(draft)
    out.write(bytearray(name.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(draft).toUri(), spark._jsc.hadoopConfiguration())
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    number = max(versions(spark, path), default=0) + 1
    while True:
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{number:08d}")), how)
            return number
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            number += 1


def state_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The numbers of a version, the last one by default."""
    known = versions(spark, path)
    version = known[-1] if version is None and known else version
    if version not in known:
        raise ValueError(f"no version {version} of a state in {path}" if known else f"no state in {path}")
    name = spark.read.text(f"{path}/versions/{version:08d}").first()[0]
    return spark.read.schema(STATE_SCHEMA).parquet(f"{path}/{name}")


class Numbers:
    """The numbers of a state by part and item, each item in the order of i and j."""

    def __init__(self, table: DataFrame):
        rows = sorted(table.collect(), key=lambda r: (r["part"], r["item"], r["i"], r["j"]))
        self.kinds = {r["kind"] for r in rows}
        self.items: dict[tuple[str, str], list] = {}
        for r in rows:
            self.items.setdefault((r["part"], r["item"]), []).append(r)

    def vector(self, part: str, item: str) -> tuple[float, ...]:
        return tuple(r["value"] for r in self.items.get((part, item), ()))

    def names(self, part: str, item: str) -> tuple[str, ...]:
        """The columns of an item, by j of its first row of numbers."""
        return tuple(r["name"] for r in self.items.get((part, item), ()) if r["i"] == 0)

    def matrix(self, part: str, item: str) -> tuple[tuple[float, ...], ...]:
        lines: dict[int, list[float]] = {}
        for r in self.items.get((part, item), ()):
            lines.setdefault(r["i"], []).append(r["value"])
        return tuple(tuple(lines[i]) for i in sorted(lines))


def vector_rows(kind: str, part: str, item: str, values: Iterable[float], names: Iterable[str] | None = None) -> list[Row]:
    values = list(values)
    return [(kind, part, item, 0, j, n, v) for j, (v, n) in enumerate(zip(values, names or [None] * len(values)))]


def matrix_rows(kind: str, part: str, item: str, lines: Iterable[Iterable[float]], names: Iterable[str]) -> list[Row]:
    names = list(names)
    return [(kind, part, item, i, j, n, v) for i, line in enumerate(lines) for j, (v, n) in enumerate(zip(line, names))]
