"""Exact near-duplicates of embeddings by dual traversal of cover trees.

Unit vectors link if their distance is at most that of the cosine threshold. Equal vectors are one
point with a count. A cover tree nests balls of halving radius; two nodes are dropped together when
their centres are farther apart than both covering radii and the link distance, and linked
together when no two of their points can be farther apart than it.

A group (equal label and dimension) that is too large for a task is cut first: points of a
sample, drawn by a hash for each group by its size and bounded in bytes over all groups, none close to another, are centres; every point is at home at its nearest centre, or
outside if that is far, and visits those cells in whose ball, widened by the link distance, it lies. A
pair is found where either of its points is at home. Cells that stay too large are dealt over a grid of
blocks.

Points without structure, as far from each other as any, would make a node for each; beyond FAN
children the rest of a node's points stay together and are compared by matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paychain.llm.common import map_batches, materialize, with_group_min
from paychain.llm.components import Forest, connected_components

COSINE = 0.98
#: Points at home in a task, points it compares them with, points of a leaf, children of a node.
HOME_ROWS, BLOCK_ROWS, LEAF, FAN = 16384, 32768, 64, 256
#: Bytes of the vectors at home in a task, and of those it compares them with: fewer points where they have many dimensions.
HOME_BYTES, BLOCK_BYTES = 16 << 20, 32 << 20
#: A large group has a centre for so many points, at least and at most so many centres; bytes of all centres together.
POINTS_A_CENTRE, LEAST_CENTRES, MOST_CENTRES, CENTRE_BYTES = 256, 16, 4096, 128 << 20
#: Points farther from every centre than so many link distances are outside.
OUTSIDE = 4.0
_SLACK = 1e-7


class Node:
    __slots__ = ("centre", "radius", "points", "children")

    def __init__(self, centre: int, radius: float, points: np.ndarray, children: list[Node]):
        self.centre, self.radius, self.points, self.children = centre, radius, points, children


def _far(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ to)))


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Node:
    """The tree over all rows of x, unit vectors; every node's points lie within its radius of its centre."""

    def node(points: np.ndarray, far: np.ndarray) -> Node:
        return Node(int(points[0]), float(far.max()), points, [])

    everything = np.arange(len(x))
    root = node(everything, _far(x, x[0]))
    open_nodes = [root]
    while open_nodes:
        at = open_nodes.pop()
        if len(at.points) <= leaf or at.radius < 1e-6:
            continue
        rest, half = at.points, at.radius / 2
        while len(rest):  # the node's own centre comes first and so is nested in the next level
            far = _far(x[rest], x[rest[0]])
            near = far <= half
            near[0] = True
            if len(at.children) >= FAN:
                at.children.append(Node(int(rest[0]), float(far.max()), rest, []))
                break
            at.children.append(node(rest[near], far[near]))
            rest = rest[~near]
        # a rest that stays together is a leaf of any size
        open_nodes += at.children[:FAN]
    return root


def dual_links(homes: np.ndarray, rows: np.ndarray, weight: np.ndarray, cosine: float, forest: Forest) -> np.ndarray:
    """For each row the weight of the homes that it links with, itself included if it is one; links are joined in the forest of homes, rows."""
    n, count = len(homes), np.zeros(len(rows), np.int64)
    reach = np.sqrt(2.0 - 2.0 * cosine)
    stack = [(cover_tree(homes), cover_tree(rows))]
    while stack:
        a, b = stack.pop()
        d = float(_far(homes[a.centre], rows[b.centre]))
        if d > a.radius + b.radius + reach + _SLACK:
            continue
        if d + a.radius + b.radius < reach - _SLACK:
            count[b.points] += weight[a.points].sum()
            forest.join(np.full(len(a.points), n + b.centre), a.points)
            forest.join(np.full(len(b.points), a.centre), n + b.points)
        elif not a.children and not b.children:
            for s in range(0, len(a.points), 1024):
                for t in range(0, len(b.points), 1024):
                    p, q = a.points[s : s + 1024], b.points[t : t + 1024]
                    links = homes[p] @ rows[q].T >= cosine
                    count[q] += weight[p] @ links
                    i, j = np.nonzero(links)
                    forest.join(p[i], n + q[j])
        elif a.children and (not b.children or a.radius >= b.radius):
            near = _far(homes[[c.centre for c in a.children]], rows[b.centre]) <= np.array([c.radius for c in a.children]) + b.radius + reach + _SLACK
            stack += [(a.children[k], b) for k in np.flatnonzero(near)]
        else:
            near = _far(rows[[c.centre for c in b.children]], homes[a.centre]) <= np.array([c.radius for c in b.children]) + a.radius + reach + _SLACK
            stack += [(a, b.children[k]) for k in np.flatnonzero(near)]
    return count


def _rows_of(rows: int, size: int) -> Column:
    """How many vectors of ``dim`` a task takes: ``rows``, but no more than ``size`` bytes."""
    return F.least(F.lit(rows), F.greatest(F.lit(1), F.floor(size / (8 * F.col("dim")))))


def _unit(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    column = batch.column("v")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = np.asarray(column.flatten()).astype(np.float64)
    return values.reshape(batch.num_rows, -1) if batch.num_rows else values.reshape(0, 0)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(key, n_links, component_id, kept) for each row of ``vectors``.

    Rows link if their labels are equal and not null and their cosine, in double precision, is at least ``cosine``. Vectors that are
    null, empty or zero, hold null or non-finite components, or differ in length link with nothing. n_links counts the
    other rows linked directly, component_id is the smallest key reachable, kept holds if that is the row's own.
    Repeated rows link like any others. A row without links, even with a null key, is its own component. Other columns are not read. No rows give no rows.
    """
    v = F.col(vector).cast("array<double>")
    peak = F.array_max(F.transform(v, F.abs))
    usable = F.col(label).isNotNull() & v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) & F.coalesce(peak > 0, F.lit(False))
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.when(usable, F.transform(v, lambda x: x + 0.0)).alias("v"))
    named = [F.xxhash64("v").alias("h0"), F.xxhash64(F.lit(1), "v").alias("h1"), F.size("v").alias("dim")]
    rows = rows.select("*", *named)
    equal = ["label", "dim", "h0", "h1"]
    points = (
        rows.where("v IS NOT NULL").groupBy(*equal).agg(F.min("key").alias("least"), F.count("*").alias("n"), F.first("v").alias("v")).withColumn("id", F.monotonically_increasing_id())
    )

    def normalise(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for x in batch.column("v"):
            x = np.asarray(x.values)
            x = x / np.abs(x).max()  # so that the length of neither tiny nor huge components is lost
            out.append(x / np.sqrt((x * x).sum()))
        at = batch.schema.get_field_index("v")
        return batch.set_column(at, "v", pa.array(out, pa.list_(pa.float64())))

    points = materialize(map_batches(points, normalise, points.schema))
    cells = _cells(points.select("label", "dim", "id", "n", "v"), cosine)
    sizes = cells.groupBy("label", "dim", "cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("all"))
    grid = sizes.select(
        F.col("label").alias("_l"), F.col("dim").alias("_d"), F.col("cell").alias("_c"), F.ceil(F.col("homes") / _rows_of(HOME_ROWS, HOME_BYTES)).cast("int").alias("s"), F.ceil(F.col("all") / _rows_of(BLOCK_ROWS, BLOCK_BYTES)).cast("int").alias("t")
    ).where("s > 1 OR t > 1")
    grid = materialize(grid)
    if grid.isEmpty():
        dealt = cells.select("label", "dim", "cell", F.lit(0).alias("part"), F.col("home").alias("left"), F.lit(True).alias("right"), "id", "n", "v")
    else:
        own = F.when(F.col("home"), F.pmod(F.xxhash64("id"), F.col("s"))).otherwise(F.lit(-1))
        col = F.pmod(F.xxhash64(F.lit(1), "id"), F.col("t"))
        t = F.col("t")
        parts = F.filter(F.sequence(F.lit(0), F.col("s") * t - 1), lambda p: (F.floor(p / t) == own) | (p % t == col))
        dealt = (
            cells.join(grid, (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d")) & (F.col("cell") == F.col("_c")), "left")
            .withColumns({"s": F.coalesce("s", F.lit(1)), "t": F.coalesce("t", F.lit(1))})
            .withColumn("part", F.explode(parts))
            .select("label", "dim", "cell", "part", (F.floor(F.col("part") / t) == own).alias("left"), (F.col("part") % t == col).alias("right"), "id", "n", "v")
        )

    def link(group: pa.Table) -> pa.Table:
        x, ids, n = _unit(group), np.asarray(group.column("id")), np.asarray(group.column("n"))
        left, right = (np.flatnonzero(np.asarray(group.column(c))) for c in ("left", "right"))
        out = {"id": [], "links": [], "to": []}
        if len(left) and len(right):
            forest, nodes = Forest(len(left) + len(right)), np.r_[ids[left], ids[right]]
            links = dual_links(x[left], x[right], n[left], cosine, forest)
            links -= n[right] * np.isin(ids[right], ids[left])  # itself; its copies are counted with the row
            # a point that is on both sides is one node
            same = {p: i for i, p in enumerate(ids[left].tolist())}
            pair = [(len(left) + j, same[p]) for j, p in enumerate(ids[right].tolist()) if p in same]
            if pair:
                forest.join(*np.array(pair).T)
            top = forest.find(np.arange(len(nodes)))
            edge = nodes[top] != nodes
            out = {"id": np.r_[ids[right][links > 0], nodes[edge]], "links": np.r_[links[links > 0], np.zeros(edge.sum(), np.int64)], "to": np.r_[ids[right][links > 0], nodes[top][edge]]}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    found = materialize(dealt.groupBy("label", "dim", "cell", "part").applyInArrow(link, "id long, links long, to long"))
    roots = connected_components(found, "id", "to")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    points = points.select(*equal, "id", "n", "least").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").join(counts, "id", "left")
    points = materialize(points.withColumn("root", F.coalesce("root", "id")))
    points = with_group_min(points, "root", "least", "component_id", "id").select(*(F.col(c).alias(f"_{c}") for c in equal), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id")
    match = (F.col("v").isNotNull()) & (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim")) & (F.col("h0") == F.col("_h0")) & (F.col("h1") == F.col("_h1"))
    done = rows.select("key", "label", F.when(F.col("v").isNotNull(), True).alias("v"), "dim", "h0", "h1").join(points, match, "left")
    component = F.coalesce("component_id", "key")
    return done.select(F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))


def _cells(points: DataFrame, cosine: float) -> DataFrame:
    """Points with the cells in which they are at home and which they visit."""
    sizes = points.groupBy("label", "dim").agg(F.count("*").alias("size"))
    wanted = F.least(F.lit(MOST_CENTRES), F.greatest(F.lit(LEAST_CENTRES), F.ceil(F.col("size") / POINTS_A_CENTRE)))
    large = materialize(sizes.where(F.col("size") > _rows_of(HOME_ROWS, HOME_BYTES)).withColumn("wanted", wanted))
    held = large.agg(F.sum(8 * F.col("wanted") * F.col("dim"))).first()[0]
    plain = points.select("label", "dim", F.lit(-1).alias("cell"), F.lit(True).alias("home"), "id", "n", "v")
    if not held:
        return plain
    share = F.col("wanted") / F.col("size") * min(1.0, CENTRE_BYTES / held)
    sample = points.join(large, ["label", "dim"]).where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) < share * (1 << 30)).select("label", "dim", "id", "v")
    reach = float(np.sqrt(2.0 - 2.0 * cosine))
    kind = points.schema["label"].dataType.simpleString()

    def net(group: pa.Table) -> pa.Table:
        """Of a group's sample points that are far from each other, in the order of their ids."""
        group = group.sort_by("id")
        x, near, kept = _unit(group), np.zeros(group.num_rows, bool), []
        for i in range(len(x)):
            if not near[i]:
                kept.append(i)
                near |= _far(x, x[i]) <= 2 * reach
        return group.take(kept).select(["label", "dim", "v"])

    drawn = sample.groupBy("label", "dim").applyInArrow(net, f"label {kind}, dim int, v array<double>").toArrow()  # CENTRE_BYTES at most
    groups: dict[tuple, list[np.ndarray]] = {}
    for g, d, v in zip(drawn.column(0).to_pylist(), drawn.column(1).to_pylist(), drawn.column(2)):
        groups.setdefault((g, d), []).append(np.asarray(v.values))
    centres = points.sparkSession.sparkContext.broadcast({k: np.stack(v) for k, v in groups.items() if len(v) > 1})
    outside, rim = -2, OUTSIDE * reach

    def nearest(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell, far = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
        for i, (g, d, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column("v"))):
            if (net := centres.value.get((g, d))) is not None:
                all_far = _far(net, np.asarray(v.values))
                far[i] = all_far.min()
                cell[i] = all_far.argmin() if far[i] <= rim else outside
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "far"])

    schema = f"label {kind}, dim int, id long, n long, v array<double>, cell int, far double"
    at_home = materialize(map_batches(points, nearest, schema))
    radii = at_home.where("cell >= 0").groupBy("label", "dim", "cell").agg(F.max("far")).collect()  # one row for each centre
    balls = points.sparkSession.sparkContext.broadcast({(r[0], r[1], r[2]): r[3] for r in radii})

    def visit(batch: pa.RecordBatch) -> pa.RecordBatch:
        """A home in cell k is nearest to centre k and within its ball; one outside is farther than the rim from every centre."""
        idx, cell, home = [], [], []
        for i, (g, d, c, v, far) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("label", "dim", "cell")), batch.column("v"), batch.column("far").to_pylist())):
            idx.append(i), cell.append(c), home.append(True)
            if c != -1:
                net = centres.value[(g, d)]
                ball = np.array([balls.value.get((g, d, k), -9.0) for k in range(len(net))])
                all_far = _far(net, np.asarray(v.values))
                there = np.flatnonzero(all_far <= np.minimum(ball + reach, far + 2 * reach) + _SLACK).tolist()
                if c != outside and far + reach >= rim - _SLACK:
                    there.append(outside)
                for k in there:
                    if k != c:
                        idx.append(i), cell.append(k), home.append(False)
        take = batch.take(pa.array(idx, pa.int64()))
        return pa.RecordBatch.from_arrays([take.column(0), take.column(1), pa.array(cell, pa.int32()), pa.array(home), take.column("id"), take.column("n"), take.column("v")], ["label", "dim", "cell", "home", "id", "n", "v"])

    return map_batches(at_home, visit, f"label {kind}, dim int, cell int, home boolean, id long, n long, v array<double>")
