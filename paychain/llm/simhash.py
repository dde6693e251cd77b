"""SimHash near-duplicates with pivot distance tables.

The Hamming distances of each fingerprint to many reference fingerprints (pivots) are computed
once and make a row of a table. The bits are cut into ``radius`` + 2 parts and every pivot looks at
one part, so by the triangle inequality two fingerprints within ``radius`` bits differ by at most
``radius`` in every coordinate, and not at all in those of two parts at least, as these hold no
differing bit.

So a fingerprint lives in one cell for each pair of parts, six at a radius of two whatever the number
of fingerprints, and a cell holds those that agree in the coordinates of both parts. Within a
cell, pairs are discarded by their greatest coordinate difference and the survivors are verified bit
by bit. Cells that are too large for a task (many near copies of one text) are dealt over a grid of
blocks, so neither side of a task is unbounded.

Where a similarity is asked for, links of fingerprints are only proposals: each is verified by the
exact Jaccard similarity of the shingle sets. Sets at 0.8 differ by about ten of 64 bits, a radius at which
pivots discard nothing (distances to a pivot spread by four), so fingerprints propose only the nearest copies
and min-wise bands, in which similar sets meet however few shingles they have, propose the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paychain.llm.common import blobs, each_part, map_batches, materialize, part_of, parts_held, with_group_min
from paychain.llm.components import Forest, connected_components

HASH_SEED = 42
#: Fingerprints of a cell that a task compares with so many rows of it; pivots of each part of the bits.
HOME_ROWS, BLOCK_ROWS, PIVOTS = 2048, 65536, 12
#: Differing bits at which fingerprints propose texts as similar.
NEAREST = 3
#: Min-wise bands of so many rows each: sets with a similarity of 0.8 share no band with a probability of 0.000015.
BANDS, BAND_ROWS = 28, 5
#: Shingles, and sets, of a band's cell that a task compares with as many others.
BLOCK_SHINGLES, BLOCK_SETS = 1 << 22, 1024

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each ``size``-word shingle, repeats included; of all words if there are fewer."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, HASH_SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], HASH_SEED) for s, e in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the shingle hashes, as a signed word."""
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(octets) < 256:
        votes = np.unpackbits(octets, axis=1).sum(0, dtype=np.int64)
    else:
        votes = np.concatenate([np.bincount(octets[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(votes * 2 > len(octets)).view(">i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(key, fp) for each row. Null and empty texts have fingerprint zero."""
    kind = docs.schema[key].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = [fingerprint(shingle_hashes(t or b"", size)) for t in blobs(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], [key, "fp"])

    return map_batches(docs.select(key, text), one, f"`{key}` {kind}, fp long")


def _pivots(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The reference fingerprints, fixed pseudo-random bits, and the bits of its part that each one looks at."""
    ends = [64 * k // (radius + 2) for k in range(radius + 3)]
    masks = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]
    return np.array([xxhash.xxh64_intdigest(f"pivot {j}") for j in range(len(masks) * PIVOTS)], np.uint64), np.repeat(np.array(masks, np.uint64), PIVOTS)


def pivot_table(prints: np.ndarray, radius: int) -> np.ndarray:
    """The distance of each fingerprint to each pivot, a row for each fingerprint."""
    pivots, masks = _pivots(radius)
    return np.stack([np.bitwise_count((prints ^ p) & m) for p, m in zip(pivots, masks)], axis=1).view(np.int8)


def _cells(table: np.ndarray) -> Iterator[np.ndarray]:
    """For each pair of parts the cell of each row: a hash of its coordinates in both."""
    parts = table.shape[1] // PIVOTS
    by = np.random.default_rng(HASH_SEED).integers(0, 1 << 63, table.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sums = (table.astype(np.uint64) * by).reshape(len(table), parts, PIVOTS).sum(2, dtype=np.uint64)
    for k, (i, j) in enumerate(combinations(range(parts), 2)):
        h = sums[:, i] + sums[:, j] + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        yield h ^ (h >> np.uint64(27))


def _near(table: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Whether rows i and j of the table, one by one, differ by at most ``most`` in every coordinate."""
    out = np.empty(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        some = slice(at, at + (1 << 16))
        out[some] = (np.abs(table[i[some]] - table[j[some]]) <= most).all(1)
    return out


def block_edges(homes: np.ndarray, rows: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links of ``homes`` to ``rows`` (distinct fingerprints each) as a spanning forest of indices in homes, rows.

    Homes within the radius of a leader form its cluster. Any other row that links to a member
    is within twice the radius of the leader, so only such rows meet the members one by one. Coordinates
    of the pivot tables decide which rows are looked at.
    """
    label = np.arange(len(homes) + len(rows))
    table, other = pivot_table(homes, radius), pivot_table(rows, radius)
    # the pivots of all parts at one place make one of all bits; rows are in the order of their distance to it
    at_home, at_row = table[:, ::PIVOTS].sum(1, dtype=np.int16), other[:, ::PIVOTS].sum(1, dtype=np.int16)
    order = np.argsort(at_row, kind="stable")
    rows, other, at_row = rows[order], other[order], at_row[order]
    free = np.ones(len(homes), bool)
    for i in range(len(homes)):
        if not free[i]:
            continue
        members = np.flatnonzero(free & (np.abs(at_home - at_home[i]) <= radius))
        members = members[(np.abs(table[members] - table[i]) <= radius).all(1)]
        members = members[np.bitwise_count(homes[members] ^ homes[i]) <= radius]
        free[members] = False
        reach = radius if len(members) == 1 else 2 * radius
        lo, hi = np.searchsorted(at_row, [at_home[i] - reach, at_home[i] + reach + 1])
        seen = lo + np.flatnonzero((np.abs(other[lo:hi] - table[i]) <= reach).all(1))
        far = np.bitwise_count(rows[seen] ^ homes[i])
        near = far <= radius
        if len(members) > 1:  # what is connected already needs no look
            fringe = np.flatnonzero(~near & (far <= reach) & (label[len(homes) + order[seen]] != label[i]))
            for at in range(0, len(fringe), 64):
                some = fringe[at : at + 64]
                near[some] = (np.bitwise_count(rows[seen[some]][:, None] ^ homes[members][None, :]) <= radius).any(1)
        linked = np.concatenate([members, len(homes) + order[seen[near]]])
        labels, first = np.unique(label[linked], return_index=True)
        if len(labels) > 1:
            for x in linked[first][labels != label[i]]:
                yield i, int(x)
            label[np.isin(label, labels)] = label[i]


def link_forest(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints ``fp`` which links connect, those at most ``radius`` bits apart."""

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.asarray(batch.column(0)).view(np.uint64)
        cells = list(_cells(pivot_table(prints, radius)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells).view(np.int64)), pa.array(np.tile(prints, len(cells)).view(np.int64))], ["cell", "fp"])

    cells = map_batches(distinct.select("fp"), deal, "cell long, fp long")
    large = materialize(
        cells.groupBy("cell").agg(F.count("*").alias("rows")).where((F.col("rows") > 2 * HOME_ROWS) | (F.col("rows") > BLOCK_ROWS)).select(
            "cell", F.ceil(F.col("rows") / HOME_ROWS).cast("int").alias("s"), F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("t")
        )
    )
    if large.isEmpty():
        dealt = cells.select("cell", F.lit(0).alias("part"), F.lit(True).alias("left"), F.lit(True).alias("right"), "fp")
    else:
        # part = home block * t + row block: a row is in one row and one column of the grid
        own, col = F.pmod(F.xxhash64("fp"), F.col("s")), F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("t"))
        grid = F.filter(F.sequence(F.lit(0), F.col("s") * F.col("t") - 1), lambda p: (F.floor(p / F.col("t")) == own) | (p % F.col("t") == col))
        dealt = (
            cells.join(large, "cell", "left")
            .withColumns({"s": F.coalesce("s", F.lit(1)), "t": F.coalesce("t", F.lit(1))})
            .withColumn("part", F.explode(grid))
            .select("cell", "part", (F.floor(F.col("part") / F.col("t")) == own).alias("left"), (F.col("part") % F.col("t") == col).alias("right"), "fp")
        )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        cell, part = np.asarray(t.column("cell")), np.asarray(t.column("part"))
        order = np.lexsort((part, cell))
        cell, part, rows = cell[order], part[order], np.asarray(t.column("fp")).view(np.uint64)[order]
        left, right = np.asarray(t.column("left"))[order], np.asarray(t.column("right"))[order]
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])])
        ends = np.r_[starts[1:], len(cell)]
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        small, alone = (ends - starts) <= 32, (ends - starts) == 1
        tiny = np.flatnonzero(np.repeat(small & ~alone, ends - starts))
        table = pivot_table(rows[tiny], radius)
        group = np.repeat(np.arange(len(starts)), ends - starts)[tiny]
        for shift in range(1, 32):
            i = np.flatnonzero(group[:-shift] == group[shift:]) if len(group) > shift else []
            if not len(i):
                break
            i = i[_near(table, i, i + shift, radius)]
            i, j = tiny[i], tiny[i + shift]
            both = ((left[i] & right[j]) | (right[i] & left[j])) & (np.bitwise_count(rows[i] ^ rows[j]) <= radius)
            a.append(i[both])
            b.append(j[both])
        for s, e in zip(starts[~small], ends[~small]):
            h, r = s + np.flatnonzero(left[s:e]), s + np.flatnonzero(right[s:e])
            both = np.r_[h, r]
            if found := list(block_edges(rows[h], rows[r], radius)):
                i, j = np.array(found).T
                a.append(h[i])
                b.append(both[j])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):  # of all links in the partition only a forest: one row at most for each fingerprint
            nodes, place = np.unique(rows[np.r_[a, b]], return_inverse=True)
            place, forest = place.reshape(-1), Forest(len(nodes))
            forest.join(place[: len(a)], place[len(a) :])
            top = forest.find(np.arange(len(nodes)))
            i = np.flatnonzero(top != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[x].view(np.int64)) for x in (i, top[i])], ["a", "b"])

    return dealt.repartition("cell", "part").mapInArrow(link, "a long, b long").where("a != b")


def _bands(shingles: np.ndarray) -> list[int]:
    """A hash for each band of the least values that ``BANDS * BAND_ROWS`` functions take on the shingles."""
    if not len(shingles):
        return []
    rng = np.random.default_rng(HASH_SEED)
    by = rng.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
    least = np.min([(by * shingles[at : at + 1024]).min(1) for at in range(0, len(shingles), 1024)], axis=0)
    seen = least.reshape(BANDS, BAND_ROWS).tobytes()
    step = 8 * BAND_ROWS
    return [xxhash.xxh64_intdigest(seen[k * step : (k + 1) * step], k) - (1 << 63) for k in range(BANDS)]


def _similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of ``pairs`` (a, b) of nodes those whose ``sets`` (node, shingles) have this Jaccard similarity; b may be the same in many pairs."""
    dealt = materialize(pairs.distinct().withColumn("_part", part_of("a")))
    held = dealt.groupBy("b").agg(parts_held(F.col("_part")).alias("held"))
    right = held.join(sets.withColumnRenamed("node", "b"), "b").select("b", each_part(F.col("held")).alias("_part"), F.col("shingles").alias("right"))
    both = dealt.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a").join(right, ["b", "_part"])

    # common / (x + y - common) in rows of their own: batches of pairs of sets would fill a Python worker
    common, sizes = F.size(F.array_intersect("left", "right")), F.size("left") + F.size("right")
    return materialize(both.where((1 + similarity) * common >= similarity * sizes - 1e-9).select("a", "b"))


def _set_links(group: pa.Table, similarity: float) -> Iterator[tuple[int, int]]:
    """Rows of a cell's part that link two components, as a forest: (root, x, y, block, n, shingles), blocks x and y compared."""
    sizes, values = np.asarray(group.column("n")), group.column("shingles").combine_chunks()
    ids = np.unique(np.asarray(values.values.slice(values.offsets[0].as_py(), int(sizes.sum()))), return_inverse=True)[1]
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    label = np.unique(np.array(group.column("root").to_pylist(), object), return_inverse=True)[1]
    block, x, y = (np.asarray(group.column(c)) for c in ("block", "x", "y"))
    places, mark = np.arange(len(sizes)), np.zeros(ids.max(initial=0) + 1, bool)
    for i in np.flatnonzero(block == x[0]):
        fits = (block == y[0]) & (label != label[i]) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-9)
        others = np.flatnonzero(fits & (places > i) if x[0] == y[0] else fits)
        if not len(others):
            continue
        own = ids[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        for j in others:  # (1 + similarity) * common >= similarity * (sizes of both)
            if label[j] != label[i] and (1 + similarity) * np.count_nonzero(mark[ids[starts[j] : starts[j] + sizes[j]]]) >= similarity * (sizes[i] + sizes[j]) - 1e-9:
                yield int(i), int(j)
                label[label == label[j]] = label[i]
        mark[own] = False


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """Rows that follow each other and are equal in the first ``by`` columns, whole numbers."""
    held, last = [], None
    for batch in batches:
        keys = np.stack([np.asarray(batch.column(k)) for k in range(by)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                if held and keys[s].tolist() != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(s, e - s))
                last = keys[s].tolist()
    if held:
        yield pa.Table.from_batches(held)


def _cell_links(cells: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between nodes of a band's cell that are in different components, enough of them to connect what all links do.

    Only cells that hold several components are looked into. Their sets are compared where they meet, so no pair is ever a
    row; a large cell is dealt over pairs of blocks.
    """
    named = cells.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("_part", part_of("node"))
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int")
    several = named.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high"), blocks.alias("blocks"), parts_held(F.col("_part")).alias("held")).where("low != high")
    open_cells = materialize(named.join(several.select("cell", "blocks", each_part(F.col("held")).alias("_part")), ["cell", "_part"]).select("cell", "node", "root", "n", "blocks"))
    block = F.pmod(F.xxhash64(F.lit(2), "node"), F.col("blocks")).cast("int")
    # a row meets its own block and every other, as the first or the second of the two
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, block).alias("x"), F.greatest(k, block).alias("y"))))
    dealt = open_cells.join(sets, "node").select("cell", pair.alias("p"), block.alias("block"), "node", "root", "n", "shingles").select("cell", "p.x", "p.y", "block", "node", "root", "n", "shingles")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for group in _groups(batches, 3):
            if edges := list(_set_links(group, similarity)):
                nodes = group.column("node").to_pylist()
                found += [(nodes[i], nodes[j]) for i, j in edges]
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], ["a", "b"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], ["a", "b"])

    by = ["cell", "x", "y"]
    return materialize(dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(link, "a binary, b binary").distinct())


def _similar_components(nodes: DataFrame, docs: DataFrame, key: str, text: str, size: int, similarity: float) -> DataFrame:
    """(node, root) of nodes that links connect; ``nodes`` has (node, least, n, bands, fp), a row for each distinct shingle set.

    First the links that fingerprints propose and those of each node to one node of every cell of its bands. Then
    the members of a cell that are still in different components are compared with each other.
    """
    dealt = materialize(nodes.select("node", "n", F.explode("bands").alias("cell")).withColumn("_part", part_of("node")))
    shared = dealt.groupBy("cell").agg(F.count("*").alias("rows"), parts_held(F.col("_part")).alias("held")).where("rows > 1")
    cells = materialize(dealt.join(shared.select("cell", each_part(F.col("held")).alias("_part")), ["cell", "_part"]).drop("_part"))

    prints = materialize(with_group_min(nodes.select("node", "fp"), "fp", "node", "first", "node"))
    firsts = prints.where(F.col("node") == F.col("first")).select("fp", "node")
    of_a, of_b = firsts.select(F.col("fp").alias("a"), F.col("node").alias("x")), firsts.select(F.col("fp").alias("b"), F.col("node").alias("y"))
    near = link_forest(firsts, NEAREST).join(of_a, "a").join(of_b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    near = near.union(prints.where(F.col("node") != F.col("first")).select("node", "first"))
    stars = with_group_min(cells.withColumn("pick", F.struct(F.xxhash64("node").alias("by"), F.col("node").alias("b"), F.col("n").alias("m"))), "cell", "pick", "star", "node")
    fits = F.least("n", "star.m") >= similarity * F.greatest("n", "star.m") - 1e-9  # sets of other sizes can't be similar
    proposed = materialize(near.union(stars.where(fits & (F.col("node") != F.col("star.b"))).select("node", "star.b")).distinct())

    need = proposed.select(F.explode(F.array("a", "b")).alias("node")).union(cells.select("node")).distinct()
    names = nodes.select("node", F.col("least").alias("_least")).join(need, "node")
    held = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(names, F.col("_key").eqNullSafe(F.col("_least"))).select("node", "_text")

    def shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(shingle_hashes(t or b"", size)).view(np.int64) for t in blobs(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])

    sets = materialize(map_batches(held, shingles, "node binary, shingles array<long>"))
    links = _similar_pairs(proposed, sets, similarity)
    roots = materialize(connected_components(links))
    return connected_components(links.union(_cell_links(cells, roots, sets, similarity)))


def similar_texts(docs: DataFrame, key: str, text: str, size: int, similarity: float) -> DataFrame:
    """(key, fp, component_id) for each row of ``docs``; component_id is the smallest key reachable by links.

    Texts are linked if the sets of their ``size``-word shingles have a Jaccard similarity of ``similarity`` or more,
    exactly; of such pairs those are missed that neither fingerprints nor bands propose. Null, empty and blank texts
    are copies of each other. Keys must be distinct, one may be null: it has the smallest key of its component, null if
    there is none. No rows give no rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints, digests, sizes, bands = [], [], [], []
        for t in blobs(batch.column(1)):
            hashes = shingle_hashes(t or b"", size)
            own = np.unique(hashes)
            prints.append(fingerprint(hashes))
            digests.append(xxhash.xxh128_digest(own.tobytes()))
            sizes.append(len(own))
            bands.append(_bands(own))
        cols = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(prints, pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols], [key, "node", "n", "bands", "fp"])

    made = materialize(map_batches(docs.select(key, text), one, f"`{key}` {kind}, node binary, n long, bands array<long>, fp long"))
    dealt = made.withColumn("_part", part_of(key))
    # of texts with one set the fingerprints may differ by repeats; any will do, the least is the same in every run
    nodes = materialize(dealt.groupBy("node").agg(F.min(key).alias("least"), parts_held(F.col("_part")).alias("held"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("fp").alias("fp")))
    roots = _similar_components(nodes, docs, key, text, size, similarity)
    linked = nodes.select("node", "least", "held").join(roots, "node", "left")
    linked = materialize(linked.withColumn("root", F.coalesce("root", "node")))
    named = with_group_min(linked, "root", "least", "component_id", "node").select("node", "component_id", each_part(F.col("held")).alias("_part"))
    return dealt.select(key, "node", "fp", "_part").join(named, ["node", "_part"]).select(key, "fp", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, radius: int = 2, similarity: float | None = None) -> DataFrame:
    """(key, fp, component_id) for each row of ``docs``; component_id is the smallest key reachable by links.

    fp is a signed 64-bit word. Rows with equal fingerprints are linked, so copies are grouped by
    an aggregation and only distinct fingerprints are compared. Null, empty and blank texts have
    fingerprint zero and are linked with each other like any other. Repeated keys are separate rows. All links are
    found; with ``similarity`` they are those of ``similar_texts``, which needs distinct keys.
    A null key has the smallest key of its component, null if there is none. Other columns are not read. No rows give no rows.
    """
    if similarity is not None:
        return similar_texts(docs, key, text, size, similarity)
    prints = materialize(fingerprints(docs, key, text, size))
    dealt = prints.withColumn("_part", part_of(key))  # copies of one text may be a third of all rows
    distinct = materialize(dealt.groupBy("fp").agg(F.min(key).alias("least"), parts_held(F.col("_part")).alias("held")))
    roots = connected_components(link_forest(distinct, radius))
    linked = distinct.select(F.col("fp").alias("node"), "least", "held").join(roots, "node", "left")
    linked = materialize(linked.withColumn("root", F.coalesce("root", "node")))
    named = with_group_min(linked, "root", "least", "component_id", "node")
    named = named.select(F.col("node").alias("fp"), "component_id", each_part(F.col("held")).alias("_part"))
    return dealt.join(named, ["fp", "_part"]).select(key, "fp", "component_id")
