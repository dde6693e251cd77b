"""k-means, k-modes and k-prototypes.

Centres are a few numbers on the driver; rows are assigned by plain expressions against them and centres
are updated by an aggregation with map-side combine. Every iteration starts from the same
input, so lineage never grows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from paychain.operators.prep import missing


def _nearest(distances: list[Column]) -> Column:
    """The index of the least distance, the first of equal ones."""
    d = F.array(*distances)
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def squared_distances(columns: list[str], centres: list[tuple[float, ...]]) -> list[Column]:
    return [sum(((F.col(c) - float(x)) * (F.col(c) - float(x)) for c, x in zip(columns, centre)), F.lit(0.0)) for centre in centres]


#: Numbers of centres up to which the distances are expressions; more are compared in blocks of rows.
EXPRESSED = 512


def assign_nearest(df: DataFrame, columns: list[str], centres: list[tuple[float, ...]], out: str = "predict_index") -> DataFrame:
    """``df`` with the index of the nearest centre, the first of equally near ones; null where a number is missing."""
    if len(centres) * len(columns) <= EXPRESSED:
        return df.withColumn(out, _nearest(squared_distances(columns, centres)))
    kept = [c for c in df.columns if c != out]
    at, every = [kept.index(c) for c in columns], np.array(centres, float)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in at], 1).astype(float)
            near = np.zeros(len(x), np.int32)
            for rows, d2 in block_distances(x, every):
                near[rows] = d2.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, mask=np.isnan(x).any(1))], [*kept, out])

    return df.select(*kept).mapInArrow(one, T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.IntegerType())]))


@dataclass(frozen=True)
class KMeansFit:
    columns: tuple[str, ...]
    centres: list[tuple[float, ...]]
    cost: float
    rounds: int = field(default=0, compare=False)  # passes over the rows for all starts together


#: Squared distances held at a time in a task, and rows that tasks may send to the driver without an aggregation between.
HELD, SENT = 1 << 22, 1 << 16


def block_distances(x: np.ndarray, centres: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Squared distances of blocks of rows to all centres, added up column by column as the expressions do."""
    step = max(1, HELD // max(1, len(centres)))
    for at in range(0, len(x), step):
        rows = slice(at, min(len(x), at + step))
        d2 = np.zeros((rows.stop - at, len(centres)))
        for j in range(x.shape[1]):
            gap = x[rows, j, None] - centres[None, :, j]
            d2 += gap * gap
        yield rows, d2


def _draws(h1: np.ndarray, h2: np.ndarray, number: int) -> np.ndarray:
    """For each row the draw of that number, between 0 and 1: any two draws of a row are independent, and so are rows."""
    return (((h1 + number * h2) & ((1 << 52) - 1)) + 0.5) / (1 << 52)


def _race(batches: Iterator[pa.RecordBatch], starts: list[np.ndarray], k: int, step: int) -> Iterator[pa.RecordBatch]:
    """(start, time, x): of each start the row of this task that wins the race for the next centre, with the chance of its squared distance."""
    best: dict[int, tuple] = {}
    for batch in batches:
        h1, h2, *cols = (np.asarray(c) for c in batch.columns)
        x = np.stack(cols, 1)
        for rows, d2 in block_distances(x, np.concatenate(starts) if step else np.zeros((1, x.shape[1]))):
            for i in range(len(starts)):
                far = d2[:, i * step : (i + 1) * step].min(1) if step else np.ones(len(d2))
                with np.errstate(divide="ignore"):
                    time = np.where(far > 0, -np.log(_draws(h1[rows], h2[rows], i * k + step)) / far, np.inf)
                if len(time) and np.isfinite(least := time.min()):
                    ties = np.flatnonzero(time == least)
                    best[i] = min([best.get(i, (np.inf, ())), *((float(least), tuple(x[rows][t].tolist())) for t in ties)])
    if best:
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array([t for t, _ in best.values()]), pa.array([v for _, v in best.values()], pa.list_(pa.float64()))], ["start", "time", "x"])


def _round(batches: Iterator[pa.RecordBatch], starts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(centre, n, cost, sums): what this task's rows add to the centres, those of all starts numbered through."""
    ends = np.cumsum([0, *map(len, starts)])
    every = np.concatenate(starts)
    n, cost, sums = np.zeros(len(every), np.int64), np.zeros(len(every)), np.zeros(every.shape)
    for batch in batches:
        x = np.stack([np.asarray(c) for c in batch.columns[2:]], 1)
        for rows, d2 in block_distances(x, every):
            for a, b in zip(ends, ends[1:]):
                near = d2[:, a:b].argmin(1)
                n[a:b] += np.bincount(near, minlength=b - a)
                cost[a:b] += np.bincount(near, d2[np.arange(len(near)), a + near], b - a)
                for j in range(x.shape[1]):
                    sums[a:b, j] += np.bincount(near, x[rows, j], b - a)
    some = np.flatnonzero(n)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(cost[some]), pa.array(list(sums[some]), pa.list_(pa.float64()))], ["centre", "n", "cost", "sums"])


def fit_kmeans(
    df: DataFrame, columns: list[str], k: int = 7, n_init: int = 20, seed: int = 0, max_iter: int = 300, tol: float = 1e-4, key: str | None = None, sent: int = SENT
) -> KMeansFit:
    """The best of ``n_init`` k-means++ starts, all of which share each pass over the rows.

    A start draws its centres with chances in proportion to the squared distance from those it has, by exponential races: one pass
    a centre for all starts. Then one pass a round moves the centres of all starts that are still open; a start is done once its centres move by no
    more than ``tol`` times the mean variance of the columns (squared), and one more pass tells its cost. Of costs that are equal but for
    rounding the first start's counts. Draws come from a digest of ``key``, or of the values where there is none (equal rows then count once in a draw). Where there are
    fewer distinct rows than clusters there are fewer centres; a centre without rows stays. Rows with a missing number are an error.
    """
    told = F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.concat_ws("|", *columns)
    digest = F.md5(F.concat(F.lit(f"{seed}|"), told).cast("binary"))
    numbers = [F.conv(F.substring(digest, at, 13), 16, 10).cast("long").alias(name) for at, name in ((1, "h1"), (14, "h2"))]
    data = df.select(*numbers, *(F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns))).persist(StorageLevel.MEMORY_AND_DISK)
    d = len(columns)
    try:
        about = data.agg(F.count("*"), *(F.var_pop(f"x{j}") for j in range(d)), *(F.count_if(missing(data, f"x{j}")) for j in range(d))).first()
        if gaps := [c for c, n in zip(columns, about[d + 1 :]) if n]:
            raise ValueError(f"there are missing numbers in {', '.join(gaps)}")
        if not about[0]:
            raise ValueError("there are no rows to cluster")
        still = tol * sum(about[1 : d + 1]) / d
        parts = data.rdd.getNumPartitions()
        starts, rounds = [np.zeros((0, d)) for _ in range(n_init)], 0
        for step in range(k):
            have = list(starts)
            won = data.mapInArrow(lambda b, have=have, step=step: _race(b, have, k, step), "start int, time double, x array<double>")
            if parts * n_init > sent:
                won = won.groupBy("start").agg(F.min(F.struct("time", "x")).alias("w")).select("start", "w.*")
            best: dict[int, tuple] = {}
            for r in won.collect():
                best[r["start"]] = min(best.get(r["start"], (np.inf, ())), (r["time"], tuple(r["x"])))
            rounds += 1
            if not best:  # no row is apart from the centres, of any start
                break
            starts = [np.vstack([c, best[i][1]]) for i, c in enumerate(starts)]
        costs: dict[int, float] = {}
        open_, steps, settled_ = list(range(n_init)), 0, set()
        while open_:
            ends = np.cumsum([0, *(len(starts[i]) for i in open_)])
            now = [starts[i] for i in open_]
            added = data.mapInArrow(lambda b, now=now: _round(b, now), "centre int, n long, cost double, sums array<double>")
            if parts * int(ends[-1]) > sent:
                added = added.groupBy("centre").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.array(*(F.sum(F.get("sums", F.lit(j))) for j in range(d))).alias("sums"))
            n, cost, sums = np.zeros(ends[-1]), np.zeros(ends[-1]), np.zeros((ends[-1], d))
            for r in added.collect():  # at most ``sent`` rows, or one for each centre
                n[r["centre"]] += r["n"]
                cost[r["centre"]] += r["cost"]
                sums[r["centre"]] += r["sums"]
            rounds, steps = rounds + 1, steps + 1
            for i, a, b in zip(open_, ends, ends[1:]):
                if i in settled_:
                    costs[i] = float(cost[a:b].sum())
                    continue
                moved = np.where(n[a:b, None] > 0, sums[a:b] / np.maximum(n[a:b, None], 1), starts[i])
                if ((moved - starts[i]) ** 2).sum() <= still or steps >= max_iter:
                    settled_.add(i)
                starts[i] = moved
            open_ = [i for i in open_ if i not in costs]
    finally:
        data.unpersist()
    least = min(costs.values())
    first = min(i for i, c in costs.items() if c <= least * (1 + 1e-9))
    return KMeansFit(tuple(columns), [tuple(map(float, c)) for c in starts[first]], costs[first], rounds)


@dataclass(frozen=True)
class Prototypes:
    """numeric means and categorical modes of each cluster."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    centres: list[tuple]
    gamma: float = 1.0
    costs: list[float] = field(default_factory=list)
    counted: list[int] = field(default_factory=list, compare=False)  # of each round, the rows whose values were counted

    def distances(self) -> list[Column]:
        n = len(self.numeric)
        out = []
        for centre in self.centres:
            differ = sum(((~F.col(c).eqNullSafe(F.lit(x))).cast("int") for c, x in zip(self.categorical, centre[n:])), F.lit(0))
            if n:
                out.append(squared_distances(list(self.numeric), [centre[:n]])[0] + self.gamma * differ)
            else:
                out.append(differ)
        return out


def assign_prototypes(df: DataFrame, p: Prototypes, out: str = "cluster") -> DataFrame:
    return df.withColumn(out, _nearest(p.distances()))


def _densities(df: DataFrame, categorical: list[str]) -> DataFrame:
    """``df`` with ``density``: the sum over attributes of how often the row's value occurs, a whole number."""
    for i, c in enumerate(categorical):
        counts = df.groupBy(F.col(c).alias(f"_v{i}")).agg(F.count("*").alias(f"_n{i}"))  # Spark broadcasts it if it is small
        df = df.join(counts, F.col(c).eqNullSafe(F.col(f"_v{i}")), "left").drop(f"_v{i}")
    return df.withColumn("density", sum((F.col(f"_n{i}") for i in range(len(categorical))), F.lit(0))).drop(*(f"_n{i}" for i in range(len(categorical))))


def cao_init(df: DataFrame, key: str, categorical: list[str], k: int, numeric: list[str] | None = None) -> list[tuple]:
    """The densest row, then k - 1 times the row with the greatest (least distance to a centre) x density; ties go to the lowest key."""
    numeric = numeric or []
    dense = _densities(df, categorical).persist(StorageLevel.MEMORY_AND_DISK)
    rows, centres = F.struct(*numeric, *categorical), []
    try:
        for _ in range(k):
            far = F.lit(1)
            if centres:
                differ = [sum(((~F.col(c).eqNullSafe(F.lit(x))).cast("int") for c, x in zip(categorical, centre[len(numeric) :])), F.lit(0)) for centre in centres]
                far = F.array_min(F.array(*differ))
            best = dense.groupBy().agg(F.min_by(rows, F.struct((-far * F.col("density")).alias("w"), F.col(key).isNull().alias("n"), F.col(key).alias("k"))).alias("r")).first()["r"]
            if best is None:
                raise ValueError("there are no rows to choose centres from")
            centres.append(tuple(best))
    finally:
        dense.unpersist()
    return centres


def huang_init(df: DataFrame, key: str, categorical: list[str], k: int, seed: int = 0) -> list[tuple]:
    """Values drawn by frequency for each attribute, then each draft moved to the nearest row not yet taken; ties go to the lowest key, null keys last.

    The value of the row with the least digest of seed, draft, attribute and key is a draw by frequency; it depends on the rows
    alone, however they are dealt. Keys are unique: a row whose key is taken is taken, so of rows without a key one can be a centre.
    """
    rows = df.select(key).limit(k).count()
    if rows < k:
        raise ValueError(f"{k} clusters need as many rows, there are {rows}")
    told = F.coalesce(F.col(key).cast("string"), F.lit(""))
    # all draws take one pass
    least = lambda j, c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(F.md5(F.concat(F.lit(f"{seed} {j} {c}|"), told).cast("binary")).alias("h"), F.col(c).alias("v"))))
    drawn = df.agg(*(least(j, c) for j in range(k) for c in categorical)).first()
    drafts = [list(drawn[j * len(categorical) : (j + 1) * len(categorical)]) for j in range(k)]
    if empty := [c for c, value in zip(categorical, drafts[0]) if value is None]:
        raise ValueError(f"{', '.join(empty)} has no values to draw from")
    centres: list[tuple] = []
    free = F.lit(True)
    for draft in drafts:
        differ = sum(((~F.col(c).eqNullSafe(F.lit(x))).cast("int") for c, x in zip(categorical, draft)), F.lit(0))
        order = F.struct(differ.alias("d"), F.col(key).isNull().alias("n"), F.col(key).alias("k"))
        best = df.where(free).groupBy().agg(F.min_by(F.struct(key, *categorical), order).alias("r")).first()["r"]
        if best is None:
            raise ValueError("there are fewer keys than clusters")
        free = free & ~F.col(key).eqNullSafe(F.lit(best[0]))
        centres.append(tuple(best[1:]))
    return centres


def _update(df: DataFrame, p: Prototypes) -> DataFrame:
    """(_c, cost, n0 .., m0 ..) of each cluster with rows: what is paid, means, and the most frequent values.

    Rows are counted by cluster and value of each attribute in one shuffle, so no task holds all values of an attribute.
    """
    d = F.array(*p.distances())
    values = [F.col(c).alias(f"v{i}") for i, c in enumerate(p.categorical)]
    assigned = df.select(*(F.col(c).alias(f"x{i}") for i, c in enumerate(p.numeric)), *values, F.array_min(d).alias("_d"), (F.array_position(d, F.array_min(d)) - 1).cast("int").alias("_c"))
    m = len(p.categorical)
    names = [f"v{i}" for i in range(m)]
    found = assigned.groupingSets([["_c"], *(["_c", v] for v in names)], "_c", *names).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("_n"), F.sum("_d").alias("cost"), *(F.avg(f"x{i}").alias(f"n{i}") for i in range(len(p.numeric)))
    )
    whole = lambda c: F.max(F.when(F.col("_g") == (1 << m) - 1, F.col(c))).alias(c)
    most = lambda i: F.min_by(f"v{i}", F.when((F.col("_g") == (1 << m) - 1 - (1 << (m - 1 - i))) & F.col(f"v{i}").isNotNull(), F.struct(-F.col("_n"), f"v{i}"))).alias(f"m{i}")
    return found.groupBy("_c").agg(whole("cost"), *(whole(f"n{i}") for i in range(len(p.numeric))), *(most(i) for i in range(m)))


def _moves(batches: Iterator[pa.RecordBatch], values: list[pa.Array], m: int, gamma: float, now: list[tuple], before: list[tuple] | None) -> Iterator[pa.RecordBatch]:
    """What this task's rows add to a round: (what, cluster, attr, value, n, x).

    0: rows of a cluster; 1: the sum of a number; 2: by how much a value's frequency in a cluster changes, for rows that ``before``
    put elsewhere (all, without it); 3: how many those rows are, and what all rows cost, added without rounding between them.
    """
    k, q = len(now), len(values)
    n, cost, sums, moved = np.zeros(k, np.int64), [], np.zeros((k, m)), 0
    change = [np.zeros((k, len(v)), np.int64) for v in values]

    def place(x: list[np.ndarray], codes: list[np.ndarray], centres: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        d2 = np.zeros((len(x[0]) if m else len(codes[0]), k))
        for c, centre in enumerate(centres):
            differ = sum((codes[i] != centre[m + i] for i in range(q)), np.zeros(len(d2), np.int64))
            for j in range(m):
                d2[:, c] += (x[j] - centre[j]) * (x[j] - centre[j])
            d2[:, c] = d2[:, c] + gamma * differ if m else differ
        near = d2.argmin(1)
        return near, d2[np.arange(len(d2)), near]

    for batch in batches:
        x = [np.asarray(batch.column(j)) for j in range(m)]
        codes = [np.asarray(pa.compute.index_in(batch.column(m + i), value_set=values[i].cast(batch.column(m + i).type)).fill_null(-1)) for i in range(q)]
        near, paid = place(x, codes, now)
        n += np.bincount(near, minlength=k)
        cost.append(math.fsum(paid))
        for j in range(m):
            sums[:, j] += np.bincount(near, x[j], k)
        old = place(x, codes, before)[0] if before else None
        some = np.flatnonzero(near != old) if before else np.arange(len(near))
        moved += len(some)
        for i in range(q):
            known = some[codes[i][some] >= 0]
            np.add.at(change[i], (near[known], codes[i][known]), 1)
            if before:
                np.add.at(change[i], (old[known], codes[i][known]), -1)
    rows = [(0, c, -1, -1, int(n[c]), 0.0) for c in np.flatnonzero(n)] + [(1, c, j, -1, 0, float(sums[c, j])) for c in np.flatnonzero(n) for j in range(m)]
    rows += [(2, c, i, v, int(change[i][c, v]), 0.0) for i in range(q) for c, v in zip(*np.nonzero(change[i]))] + [(3, -1, -1, -1, moved, math.fsum(cost))]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["what", "cluster", "attr", "value", "n", "x"])


def _fit_by_moves(df: DataFrame, p: Prototypes, values: list[list], max_iter: int, fixed: bool, sent: int) -> Prototypes:
    """The rounds of ``fit_prototypes`` where an attribute's values are few: frequencies stay on the driver, and a round counts the rows that moved alone."""
    m, k = len(p.numeric), len(p.centres)
    data = df.select(*(F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(p.numeric)), *(F.col(c).alias(f"v{i}") for i, c in enumerate(p.categorical))).persist(StorageLevel.MEMORY_AND_DISK)
    held = [pa.array(v) for v in values]
    place = [{v: i for i, v in enumerate(vs)} for vs in values]
    frequency = [np.zeros((k, len(v)), np.int64) for v in values]
    coded = lambda centre: (*centre[:m], *(-1 if x is None else place[i].get(x, -2) for i, x in enumerate(centre[m:])))
    before = None
    parts = data.rdd.getNumPartitions()
    try:
        for _ in range(max_iter):
            now, gamma = [coded(c) for c in p.centres], p.gamma
            found = data.mapInArrow(lambda b, now=now, before=before: _moves(b, held, m, gamma, now, before), "what int, cluster int, attr int, value int, n long, x double")
            if parts * k * (m + 1 + sum(map(len, values))) > sent:
                found = found.groupBy("what", "cluster", "attr", "value").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
            n, paid, sums, moved = np.zeros(k, np.int64), [], np.zeros((k, m)), 0
            for what, c, i, v, count, x in found.collect():  # no more than ``sent`` rows, or one for each number
                if what == 0:
                    n[c] += count
                elif what == 1:
                    sums[c, i] += x
                elif what == 2:
                    frequency[i][c, v] += count
                else:
                    moved += count
                    paid.append(x)
            cost = math.fsum(paid)
            if not fixed and p.costs and cost >= p.costs[-1] - 1e-9 * abs(p.costs[-1]):  # sums differ by rounding
                break
            modes = [[values[i][f[c].argmax()] if f[c].any() else None for i, f in enumerate(frequency)] for c in range(k)]
            centres = [(*map(float, sums[c] / n[c]), *modes[c]) if n[c] else p.centres[c] for c in range(k)]
            before = now
            p = Prototypes(p.numeric, p.categorical, centres, p.gamma, [*p.costs, cost], [*p.counted, moved])
    finally:
        data.unpersist()
    return p


def fit_prototypes(
    df: DataFrame, categorical: list[str], centres: list[tuple], numeric: list[str] | None = None, gamma: float | None = None, max_iter: int = 100, fixed: bool = False, sent: int = SENT
) -> Prototypes:
    """Batch iterations of assignment and update until the cost stops falling, or exactly ``max_iter`` of them if ``fixed``.

    Numeric columns take their mean; attributes the most frequent value, the lowest of equally frequent ones. A
    cluster without rows keeps its centre. gamma, the weight of a differing attribute, is half the mean of the
    numeric standard deviations unless given; at 0 only numbers count. A missing number is an error. The batch update has the
    fixed points of the row-by-row one, but its path may differ.

    Where the attributes have no more than ``sent`` values in all clusters together, their frequencies stay on the driver and a round
    changes them by the rows that moved. Where they have more, every round counts all rows in an aggregation and only centres come to the driver.
    """
    numeric = numeric or []
    if numeric:
        row = df.agg(*(F.stddev_pop(c) for c in numeric), *(F.count_if(missing(df, c)) for c in numeric)).first()
        if gaps := [c for c, n in zip(numeric, row[len(numeric) :]) if n]:
            raise ValueError(f"there are missing numbers in {', '.join(gaps)}")
        gamma = 0.5 * sum(x or 0.0 for x in row[: len(numeric)]) / len(numeric) if gamma is None else gamma
    p = Prototypes(tuple(numeric), tuple(categorical), list(centres), 1.0 if gamma is None else gamma, [])
    most = sent // max(1, len(centres))
    values: list[list] = []
    for c in categorical:
        values.append([r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(most + 1).collect()])
        most -= len(values[-1])
        if most < 0:
            break
    if most >= 0 and categorical and centres:
        order = [[r[0] for r in df.sparkSession.createDataFrame([(v,) for v in vs], df.select(c).schema).orderBy(c).collect()] if vs else [] for c, vs in zip(categorical, values)]
        return _fit_by_moves(df, p, order, max_iter, fixed, sent)
    for _ in range(max_iter):
        rows = _update(df, p).collect()  # k rows
        cost = float(sum(r["cost"] for r in rows))
        if not fixed and p.costs and cost >= p.costs[-1] - 1e-9 * abs(p.costs[-1]):  # sums differ by rounding
            break
        centres = list(p.centres)
        for r in rows:
            centres[r["_c"]] = tuple(r[f"n{i}"] for i in range(len(numeric))) + tuple(r[f"m{i}"] for i in range(len(categorical)))
        p = Prototypes(p.numeric, p.categorical, centres, p.gamma, [*p.costs, cost])
    return p


def fit_kmodes(df: DataFrame, key: str, columns: list[str], k: int = 4, init: str = "huang", n_init: int = 5, seed: int = 0, max_iter: int = 100) -> Prototypes:
    """The best of ``n_init`` seeded Huang starts, or the one Cao start."""
    if init == "cao":
        return fit_prototypes(df, columns, cao_init(df, key, columns, k), max_iter=max_iter)
    fits = [fit_prototypes(df, columns, huang_init(df, key, columns, k, seed + i), max_iter=max_iter) for i in range(n_init)]
    return min(fits, key=lambda p: p.costs[-1])


def centre_table(spark, p: Prototypes) -> DataFrame:
    """(cluster, attr, value): the centres, values as text."""
    rows = [(i, c, None if x is None else str(x)) for i, centre in enumerate(p.centres) for c, x in zip((*p.numeric, *p.categorical), centre)]
    return spark.createDataFrame(rows, "cluster int, attr string, value string")
