"""Robust scaling, whitening and uniform quantiles: small fitted states, applied as expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paychain.sources.scratch import running_totals


@dataclass(frozen=True)
class RobustParams:
    columns: tuple[str, ...]
    low: tuple[float, ...]
    median: tuple[float, ...]
    high: tuple[float, ...]

    def scale(self, i: int) -> float:
        """The range between the quartiles, 1 where there is none."""
        return (self.high[i] - self.low[i]) or 1.0


def quantiles(df: DataFrame, columns: list[str], levels: list[float], exact: bool = True, accuracy: int = 100_000) -> list[list[float]]:
    """The quantiles of each column, interpolated if ``exact``; else from a mergeable sketch of bounded size, in one pass.

    For exact ones the distinct values of all columns are counted, sorted by ranges and numbered by running totals; only the
    values at the ranks that the levels need come to the driver. NaN and null are left out; a column without values has none (an
    empty list).
    """
    found = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns]
    if not exact:
        level = F.array(*map(F.lit, levels))
        row = df.agg(*(F.percentile_approx(c, level, accuracy).alias(f"q{i}") for i, c in enumerate(found))).first()
        return [list(r) if r is not None else [] for r in row]
    values = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("c"), x.alias("v")) for i, x in enumerate(found)))).alias("p")).select("p.*").where("v IS NOT NULL")
    counts = values.groupBy("c", (F.col("v") + 0.0).alias("v")).agg(F.count("*").alias("n"))
    at = np.array(levels, float)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(c, n, rank, v) of the values at the ranks below and above each level."""
        for batch in batches:
            c, v, n, upto, total = (np.asarray(batch.column(k)) for k in ("c", "v", "n", "upto_n", "all_n"))
            for size in np.unique(total):
                ranks = np.unique(np.concatenate([np.floor(at * (size - 1)), np.ceil(at * (size - 1))])).astype(np.int64)
                here = np.flatnonzero(total == size)
                low, high = np.searchsorted(ranks, upto[here] - n[here]), np.searchsorted(ranks, upto[here])
                some = np.repeat(here, high - low)
                rank = ranks[np.arange(len(some)) - np.repeat(np.cumsum(high - low) - high, high - low)]
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c[some], total[some], rank, v[some])], ["c", "n", "rank", "v"])

    rows = running_totals(counts, ["c"], [F.col("v")], ["n"]).mapInArrow(hold, "c int, n long, rank long, v double").collect()  # two for each level and column
    held, sizes = {(r["c"], r["rank"]): r["v"] for r in rows}, {r["c"]: r["n"] for r in rows}
    out = []
    for i in range(len(columns)):
        out.append([])
        for x in at * (sizes[i] - 1) if i in sizes else ():
            low, high = held[i, int(np.floor(x))], held[i, int(np.ceil(x))]
            out[-1].append(float(low if low == high else (np.ceil(x) - x) * low + (x - np.floor(x)) * high))
    return out


def group_quantiles(df: DataFrame, by: str, columns: list[str], levels: Callable[[int], list[float]]) -> DataFrame:
    """(by, c, q): of each value of ``by`` (null is one) and column c, by its place, the exact quantiles at ``levels`` of the number of its values.

    As in ``quantiles`` values are counted, sorted by ranges and numbered by running totals, of all groups at once: no task sees a whole
    group, and one row a group is as long as its levels. Columns without values have no row.
    """
    found = F.array(*(F.struct(F.lit(i).alias("c"), (F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double")) + 0.0).alias("v")) for i, x in enumerate(columns)))
    counts = df.select(F.col(by).alias("_by"), F.explode(found).alias("p")).select("_by", "p.*").where("v IS NOT NULL").groupBy("_by", "c", "v").agg(F.count("*").alias("n"))

    def near(size: int) -> np.ndarray:
        at = np.asarray(levels(size), float) * (size - 1)
        return np.unique(np.concatenate([np.floor(at), np.ceil(at)])).astype(np.int64)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``df``'s rows at the ranks below and above each level, with those ranks."""
        ranks: dict[int, np.ndarray] = {}
        for batch in batches:
            n, upto, total = (np.asarray(batch.column(x)) for x in ("n", "upto_n", "all_n"))
            for size in np.unique(total):
                wanted = ranks.setdefault(int(size), near(int(size)))
                here = np.flatnonzero(total == size)
                low, high = np.searchsorted(wanted, upto[here] - n[here]), np.searchsorted(wanted, upto[here])
                some = pa.array(np.repeat(here, high - low))
                rank = wanted[np.arange(len(some)) - np.repeat(np.cumsum(high - low) - high, high - low)]
                if len(some):
                    yield pa.RecordBatch.from_arrays([*(batch.column(x).take(some) for x in ("_by", "c", "all_n")), pa.array(rank), batch.column("v").take(some)], ["_by", "c", "n", "rank", "v"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for size, held in zip(batch.column("n").to_pylist(), batch.column("held").to_pylist()):
                value, found = {h["rank"]: h["v"] for h in held}, []
                for x in np.asarray(levels(size), float) * (size - 1):
                    low, high = value[int(np.floor(x))], value[int(np.ceil(x))]
                    found.append(float(low if low == high else (np.ceil(x) - x) * low + (x - np.floor(x)) * high))
                told.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("_by"), batch.column("c"), pa.array(told, pa.list_(pa.float64()))], ["_by", "c", "q"])

    kind = T.StructField("_by", df.schema[by].dataType)
    line = lambda *more: T.StructType([kind, T.StructField("c", T.IntegerType()), *more])
    numbers = T.StructField("n", T.LongType()), T.StructField("rank", T.LongType()), T.StructField("v", T.DoubleType())
    rows = running_totals(counts, ["_by", "c"], [F.col("v")], ["n"]).mapInArrow(hold, line(*numbers))
    held = rows.groupBy("_by", "c").agg(F.max("n").alias("n"), F.collect_list(F.struct("rank", "v")).alias("held"))
    return held.mapInArrow(join, line(T.StructField("q", T.ArrayType(T.DoubleType())))).withColumnRenamed("_by", by)


def interpolated(values: np.ndarray, levels: list[float]) -> list[float]:
    """The quantiles of sorted values, interpolated as ``quantiles`` does; none of none."""
    if not len(values):
        return []
    x = np.asarray(levels, float) * (len(values) - 1)
    low, high = values[np.floor(x).astype(np.int64)], values[np.ceil(x).astype(np.int64)]
    return np.where(low == high, low, (np.ceil(x) - x) * low + (x - np.floor(x)) * high).tolist()


def fit_robust(df: DataFrame, columns: list[str], exact: bool = True) -> RobustParams:
    """Quartiles and median of each column; a column without values scales by 1 around 0."""
    q = [x or [0.0, 0.0, 0.0] for x in quantiles(df, columns, [0.25, 0.5, 0.75], exact)]
    return RobustParams(tuple(columns), *(tuple(x[k] for x in q) for k in range(3)))


def apply_robust(df: DataFrame, params: RobustParams) -> DataFrame:
    return df.withColumns({c: (F.col(c) - params.median[i]) / params.scale(i) for i, c in enumerate(params.columns)})


@dataclass(frozen=True)
class Whitening:
    columns: tuple[str, ...]
    mean: tuple[float, ...]
    variances: tuple[float, ...]
    rows: tuple[tuple[float, ...], ...]  # of each component: the weights of the centred columns


#: Columns beyond which moments and components are matrix products in tasks, not an expression for each pair.
WIDE = 32


def covariances(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(means, covariance matrix with n - 1) of rows without missing numbers in ``columns``; a pair's rows need no other columns where there are few.

    Few columns: one aggregation. Many: tasks add up blocks' matrix products about the means, a row of the matrix is summed in one place,
    and only the matrix comes to the driver, columns x columns numbers.
    """
    d = len(columns)
    if d <= WIDE:
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        row = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
        cov = np.zeros((d, d))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
        return np.array([row[f"m{i}"] or 0.0 for i in range(d)]), cov
    rows = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d)
        for x in _blocks(batches):
            n, total = n + len(x), total + x.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    def add(group: pa.Table) -> pa.Table:
        lines = sum((np.stack(c.to_numpy(zero_copy_only=False)).sum(0) for c in group.column("line").chunks), np.zeros(d))
        return pa.table({"i": pa.array([group.column("i")[0].as_py()], pa.int32()), "line": pa.array([lines], pa.list_(pa.float64()))})

    # a task's sums are a row; they add up in a few places first
    parts = rows.mapInArrow(sums, "n long, total array<double>").select(F.lit(0).alias("i"), F.concat(F.array(F.col("n").cast("double")), "total").alias("line"))

    def add_sums(group: pa.Table) -> pa.Table:
        lines = sum((np.stack(c.to_numpy(zero_copy_only=False)).sum(0) for c in group.column("line").chunks), np.zeros(d + 1))
        return pa.table({"i": pa.array([0], pa.int32()), "line": pa.array([lines], pa.list_(pa.float64()))})

    schema = "i int, line array<double>"
    spread = parts.withColumn("i", F.pmod(F.monotonically_increasing_id(), F.lit(64)).cast("int")).groupBy("i").applyInArrow(add_sums, schema)
    n, *total = np.sum([r["line"] for r in spread.collect()] or [np.zeros(d + 1)], 0)
    mean = np.array(total) / max(n, 1)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((d, d))
        for x in _blocks(batches):
            x = x - mean
            found += x.T @ x
        for at in range(0, d, 64):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, min(d, at + 64)), pa.int32()), pa.array(list(found[at : at + 64]), pa.list_(pa.float64()))], ["i", "line"])

    cov = np.zeros((d, d))
    for r in rows.mapInArrow(products, schema).groupBy("i").applyInArrow(add, schema).collect():
        cov[r["i"]] = r["line"]
    return mean, cov / max(n - 1, 1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of numbers, those with a missing one left out."""
    for batch in batches:
        if batch.num_rows:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1).astype(float)
            yield x[~np.isnan(x).any(1)]


def leading(cov: np.ndarray, k: int, rounds: int = 300, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a covariance matrix, falling, and their vectors as columns.

    Where few of many are asked for, by subspace iteration from a random start until their residuals are at rounding; the whole decomposition
    otherwise, and where that doesn't settle.
    """
    d = len(cov)
    if d > 4 * (k + 16):
        q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, k + 16)))[0]
        for _ in range(rounds):
            q = np.linalg.qr(cov @ (cov @ q))[0]
            values, turn = np.linalg.eigh(q.T @ cov @ q)
            vectors = q @ turn[:, ::-1][:, :k]
            values = values[::-1][:k]
            if np.abs(cov @ vectors - vectors * values).max() <= 1e-12 * max(abs(values[0]), 1e-300):
                return values, vectors
    values, vectors = np.linalg.eigh(cov)
    return values[::-1][:k], vectors[:, ::-1][:, :k]


def fit_whiten(df: DataFrame, columns: list[str], components: int) -> Whitening:
    """Principal components scaled to unit variance (n - 1), at most as many as columns.

    Only the covariances, columns x columns numbers, come to the driver and are solved there. The largest
    weight of a component is positive, which fixes its sign. Components without variance are left out.
    """
    d = len(columns)
    mean, cov = covariances(df, columns)
    values, vectors = leading(cov, min(components, d))
    most, rows, kept = max(float(values.max(initial=0.0)), 1e-300), [], []
    for value, v in zip(values, vectors.T):
        if value > 1e-12 * most:
            kept.append(float(value))
            rows.append(tuple(map(float, v * np.sign(v[np.abs(v).argmax()]) / np.sqrt(value))))
    return Whitening(tuple(columns), tuple(map(float, mean)), tuple(kept), tuple(rows))


def apply_whiten(df: DataFrame, w: Whitening, prefix: str = "pc") -> DataFrame:
    """``df`` with the components pc1 ..; of many columns they are matrix products of blocks of rows, null where a number is missing."""
    names = [f"{prefix}{k + 1}" for k in range(len(w.rows))]
    if len(w.columns) <= WIDE:
        return df.withColumns({name: sum((F.lit(x) * (F.col(c) - m) for x, c, m in zip(row, w.columns, w.mean)), F.lit(0.0)) for name, row in zip(names, w.rows)})
    weights, mean = np.array(w.rows), np.array(w.mean)
    kept = [c for c in df.columns if c not in names]
    at = [kept.index(c) for c in w.columns]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in at], 1).astype(float)
            found = (x - mean) @ weights.T
            gone = np.isnan(found).any(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.float64(), mask=gone) for c in found.T)], [*kept, *names])

    out = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(n, T.DoubleType()) for n in names)])
    return df.select(*kept).mapInArrow(one, out)


@dataclass(frozen=True)
class QuantileMap:
    columns: tuple[str, ...]
    landmarks: tuple[tuple[float, ...], ...]


def fit_quantiles(df: DataFrame, columns: list[str], n: int = 1000, exact: bool = True) -> QuantileMap:
    """Up to ``n`` evenly spaced quantiles of each column, no more than there are rows."""
    n = max(2, min(n, df.count()))
    levels = [k / (n - 1) for k in range(n)]
    return QuantileMap(tuple(columns), tuple(tuple(x) or (0.0, 0.0) for x in quantiles(df, columns, levels, exact)))


def interp_two_sided(landmarks: tuple[float, ...]):
    """A vectorised function of values to their level: the mean of interpolation from below and above, so ties get their middle."""
    q = np.asarray(landmarks)
    r = np.linspace(0, 1, len(q))

    @F.pandas_udf("double")
    def level(x: pd.Series) -> pd.Series:
        v = x.to_numpy(dtype=float)
        return pd.Series(0.5 * (np.interp(v, q, r) - np.interp(-v, -q[::-1], -r[::-1])))

    return level


def apply_quantiles(df: DataFrame, m: QuantileMap) -> DataFrame:
    return df.withColumns({c: interp_two_sided(q)(F.col(c)) for c, q in zip(m.columns, m.landmarks)})
