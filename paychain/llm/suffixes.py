"""Removal of repeated byte strings with a distributed, sparse suffix array.

A window is a string of ``length`` bytes. Its anchor is the leftmost place, among its first
``SPREAD``, whose 8 bytes have the least hash; equal windows have their anchors at the same offset.
A run of consecutive windows shares an anchor, so only the suffixes at anchors are sorted, one in about
a hundred. A suffix is a sequence of tokens, fingerprints of what follows and surrounds the anchor:
first the bytes which all windows of the run hold from the anchor on, then everything the run covers.

Sampled splitters deal the suffixes into ranges of leading tokens; a range is sorted by multikey
quicksort and neighbours are compared, also across the boundaries of ranges. So no group is ever
gathered: a third of all suffixes may be equal and is still cut into ranges.

Neighbours that share all tokens make all windows of their runs repeated. Where they share
the first token alone, some windows of the runs may be equal: of such runs, one of each kind is
cut into parts, which go through the same sort, and what is still open of these into windows.

Consecutive runs of one text that are equal in all tokens (padding, repeated lines) become one row.

The same sort tells which texts share a passage: there the sequence is one of words, and a text that holds
a run of words which another text holds too is marked, whatever its length in bytes.

Fingerprints of 128 bits stand for the strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paychain.llm.common import blobs, discard, map_batches, materialize, small_batches

LENGTH = 400
#: Anchors are among so many first places of a window; texts are hashed in pieces of so many bytes.
SPREAD, PIECE = 192, 1 << 18
#: Words of a passage that texts may share; anchors of its windows are among so many first words.
PASSAGE, WORD_SPREAD = 51, 40
#: Runs that are partly repeated are looked into by parts of so many windows.
PART = 16

#: Suffixes that a range has, about, where Spark's own number of ranges would make them larger: a task holds a range.
RANGE_ROWS = 1 << 21
#: Strings whose fingerprints are told apart by all of their bits: sums modulo 2^64 repeat for some strings of 1024 and more.
LONGEST = 1000

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLES: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes, powers of a base and of its inverse modulo 2^64, n of them at least."""
    if which in _TABLES and len(_TABLES[which][1]) >= n:
        return _TABLES[which]
    base = int(_ODD[which]) | 1
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    _TABLES[which] = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD[1 - which]), np.cumprod(up), np.cumprod(down)
    return _TABLES[which]


class Hashes:
    """Fingerprints of any part of a sequence of bytes, or of 64-bit codes, in constant time each."""

    def __init__(self, data: np.ndarray, which: int):
        n = 1 << max(12, int(len(data)).bit_length())
        values, up, self.down = _powers(which, n)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        codes = values[data] if data.dtype == np.uint8 else _mix(data * _ODD[1 - which])
        np.cumsum(codes * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def runs(data: np.ndarray, length: int, spread: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last) for each run of windows that share an anchor."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    places = []
    for at in range(0, n, PIECE):
        m = min(PIECE, n - at)  # windows that start in this piece
        need = m + spread - 1
        grams = data[at : at + need] if data.dtype != np.uint8 else np.ndarray((need,), "<u8", data.tobytes() if not data.flags.c_contiguous else data, offset=at, strides=(1,))
        keys = grams * _ODD[0]
        keys = (keys ^ (keys >> np.uint64(29))) * _ODD[1]
        keys = (keys & ~np.uint64((1 << 20) - 1)) | np.arange(need, dtype=np.uint64)
        full = -(-need // spread) * spread
        padded = np.full(full, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[:need] = keys
        blocks = padded.reshape(-1, spread)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[:m], ahead[spread - 1 : spread - 1 + m])
        places.append(at + (least & np.uint64((1 << 20) - 1)).astype(np.int64))
    place = np.concatenate(places)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return place[first], first, np.r_[first[1:], n] - 1


def tokens_of(core: Hashes, whole: Hashes, anchor: np.ndarray, first: np.ndarray, last: np.ndarray, group: np.ndarray, width: int, length: int) -> list[np.ndarray]:
    """Both tokens of runs of windows whose offsets before the anchor are in [group * width, group * width + width).

    The first is of the bytes that every window with such an offset holds, the second of all that the run covers.
    """
    start = anchor - group * width
    leading = _mix(core.of(start, start + length - width + 1) + group.astype(np.uint64) * _ODD[0])
    return [leading, _mix(whole.of(first, last + length) + (anchor - first).astype(np.uint64) * _ODD[0] + (last - anchor).astype(np.uint64) * _ODD[1])]


def suffix_tokens(data: np.ndarray, length: int, spread: int) -> list[np.ndarray]:
    """[first token, second token, anchor, first window, last window] of each run of a sequence."""
    anchor, first, last = runs(data, length, spread)
    return [*tokens_of(Hashes(data, 0), Hashes(data, 1), anchor, first, last, np.zeros(len(anchor), np.int64), spread, length), anchor, first, last]


def collapsed(found: list[np.ndarray]) -> list[np.ndarray]:
    """``suffix_tokens`` with consecutive runs that are equal in both tokens as one, and the last window of them all."""
    core, whole, _, _, last = found
    new = np.flatnonzero(np.r_[True, (core[1:] != core[:-1]) | (whole[1:] != whole[:-1])]) if len(core) else np.empty(0, np.int64)
    return [*(x[new] for x in found), last[np.r_[new[1:], len(core)] - 1] if len(core) else last]


def word_codes(text: bytes) -> np.ndarray:
    """A 64-bit code of each word between white space."""
    data = np.frombuffer(text, np.uint8)
    word = np.r_[False, (data != 32) & ((data < 9) | (data > 13)), False]
    turns = np.flatnonzero(word[1:] != word[:-1])
    return Hashes(data, 0).of(turns[::2], turns[1::2]) if len(turns) else np.empty(0, np.uint64)


def passage_windows(text: bytes, cores: np.ndarray, passage: int, spread: int) -> np.ndarray:
    """Fingerprints of the windows of ``passage`` words whose run has one of these first tokens, each once."""
    codes = word_codes(text)
    core, _, _, first, last = suffix_tokens(codes, passage, spread)
    hit = np.flatnonzero(np.isin(core.view(np.int64), cores))
    at = np.concatenate([np.arange(first[k], last[k] + 1) for k in hit])
    return np.unique(Hashes(codes, 1).of(at, at + passage).view(np.int64))


def part_tokens(text: bytes, found: list[dict], length: int, width: int) -> list[np.ndarray]:
    """suffix_tokens and whether the run is single, for the parts of ``width`` offsets of the runs found."""
    data = np.frombuffer(text, np.uint8)
    rows = []
    for r in found:
        a, lo, hi = r["anchor"], r["lo"], r["hi"]
        for g in range((a - hi) // width, (a - lo) // width + 1):
            rows.append((a, max(lo, a - g * width - width + 1), min(hi, a - g * width), g, r["single"]))
    anchor, first, last, group, single = np.array(rows, np.int64).T
    return [*tokens_of(Hashes(data, 0), Hashes(data, 1), anchor, first, last, group, width, length), anchor, first, last, single.astype(bool)]


def multikey_order(tokens: list[np.ndarray]) -> np.ndarray:
    """The order of rows by tokens: a quicksort by the first, then within runs of equal ones by the next."""
    order = np.argsort(tokens[0], kind="quicksort")
    same = np.zeros(len(order), bool)
    for depth in range(1, len(tokens)):
        t = tokens[depth - 1][order]
        same = np.r_[False, t[1:] == t[:-1]] & (same if depth > 1 else True)
        run = np.cumsum(~same)
        tied = same | np.r_[same[1:], False]
        at = np.flatnonzero(tied)
        order[at] = order[at][np.lexsort((tokens[depth][order[at]], run[at]))]
    return order


def shared_with_neighbours(rows: DataFrame, tokens: list[str], ties: list[str], also: Column | None = None) -> DataFrame:
    """The rows that share leading tokens with a neighbour in token order, and how many: columns before and after.

    Spark samples the splitters of the ranges; ``ties`` spread rows that are equal in all tokens over ranges.
    Each range also hands out its first and last row, and these are compared with each other. Rows for which ``also`` holds
    come out in any case.
    """
    names, also = rows.columns, F.lit(False) if also is None else also
    rows = rows.withColumn("also", also)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "before int, after int, part int, first boolean, last boolean"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        columns = [np.asarray(table.column(t)) for t in tokens]
        order = multikey_order(columns)
        shared, equal = np.zeros(len(order), np.int32), np.ones(len(order) - 1, bool)
        for c in columns:
            c = c[order]
            equal &= c[1:] == c[:-1]
            shared[1:] += equal
        after = np.r_[shared[1:], np.int32(0)]
        first = np.arange(len(order)) == 0
        keep = np.flatnonzero((shared > 0) | (after > 0) | first | first[::-1] | np.asarray(table.column("also"))[order])
        out = table.take(pa.array(order[keep]))
        part = np.full(len(keep), TaskContext.get().partitionId(), np.int32)
        for name, c in (("before", shared[keep]), ("after", after[keep]), ("part", part), ("first", first[keep]), ("last", first[::-1][keep])):
            out = out.append_column(name, pa.array(c))
        yield from out.combine_chunks().to_batches(max_chunksize=50_000)

    ranges = -(-rows.count() // RANGE_ROWS)
    more = [ranges] if ranges > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    found = materialize(rows.repartitionByRange(*more, *tokens, *ties).mapInArrow(sort, schema))
    edges = found.where("first OR last")
    by = W.orderBy("part", "last")  # two rows for each range

    def common(other) -> F:
        n, equal = F.lit(0), F.lit(True)
        for t in tokens:
            equal = equal & F.coalesce(other(t) == F.col(t), F.lit(False))
            n = n + equal.cast("int")
        return n

    edges = edges.withColumns({"_b": common(lambda t: F.lag(t).over(by)), "_a": common(lambda t: F.lead(t).over(by))})
    edges = edges.withColumns({"before": F.when(F.col("first"), F.col("_b")).otherwise(F.col("before")), "after": F.when(F.col("last"), F.col("_a")).otherwise(F.col("after"))})
    both = found.where("NOT first AND NOT last").union(edges.drop("_b", "_a")).select(*names, "also", "before", "after")
    return both.where("before > 0 OR after > 0 OR also").drop("also")


def _merged(start: np.ndarray, end: np.ndarray) -> list[list[int]]:
    """Maximal runs of the union of spans."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    return np.stack([start[new], end[np.r_[new[1:], True]]], 1).tolist()


def _ends(lists: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(starts, ends) of each list of spans."""
    return [tuple(np.asarray(x.values.field(k)) for k in (0, 1)) if x.is_valid else (np.empty(0, np.int32),) * 2 for x in lists]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, spread: int = SPREAD, texts: bool = True, passage: int = PASSAGE) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans, with ``texts`` kept, and shares_passage) for each row of ``docs``.

    Every byte is removed that some string of ``length`` bytes covers which also starts anywhere else, in
    any text or the same one; strings are judged on the input. spans are the maximal removed runs of bytes,
    kept the remaining bytes (which may cut a character). Null texts are empty; texts under ``length`` bytes keep
    all. Rows that are equal in key and text repeat each other. shares_passage tells whether another row holds ``passage`` consecutive
    words of the text too; nothing is removed for that. Other columns are not read. No rows give no rows.
    """
    spread, word_spread = min(spread, max(1, length - 8)), min(WORD_SPREAD, passage - 1)
    if max(length + spread, passage + word_spread) > LONGEST:
        raise ValueError(f"strings and what their runs cover may have no more than {LONGEST} bytes or words")
    kind = docs.schema[key].dataType.simpleString()
    small_batches(docs.sparkSession)
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("print"))
    row = ["key", "print"]
    same_row = F.col("key").eqNullSafe(F.col("_key")) & (F.col("print") == F.col("_print"))
    by_row = [F.col(c).alias(f"_{c}") for c in row]
    tokens = f"core long, whole long, anchor int, lo int, hi int, key {kind}, print long"
    names = ["core", "whole", "anchor", "lo", "hi", *row]

    def block(parts: list[list[np.ndarray]], at: list[int], batch: pa.RecordBatch, more: list[str]) -> pa.RecordBatch:
        """A row for each run found in the texts ``at`` of the batch; places that a kind of run doesn't have are null."""
        rows = pa.array(np.repeat(at, [len(p[0]) for p in parts]))
        core, whole, *places = (np.concatenate(x) for x in zip(*parts))
        ints = [pa.array(x.astype(np.int32)) for x in places[:3]] or [pa.nulls(len(core), pa.int32())] * 3
        last = [pa.array(x if x.dtype == bool else x.astype(np.int32)) for x in places[3:]] or [pa.nulls(len(core), pa.int32())]
        cols = [pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), *ints, batch.column(0).take(rows), batch.column(2).take(rows), *last]
        return pa.RecordBatch.from_arrays(cols, [*names, *more])

    def words_of(text: bytes) -> list[np.ndarray]:
        core, whole = suffix_tokens(word_codes(text), passage, word_spread)[:2]
        once = np.unique(core + whole * _ODD[0], return_index=True)[1]
        return [core[once], whole[once]]  # each kind of run once, so what meets is in another row

    def suffixes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of ``tokens`` and upto: the runs of bytes of the texts, and without places those of words."""
        for batch in batches:
            parts, at, of_words, word_at, size = [], [], [], [], 0
            for i, t in enumerate(blobs(batch.column(1))):
                if t and len(t) >= length:
                    parts.append(collapsed(suffix_tokens(np.frombuffer(t, np.uint8), length, spread)))
                    at.append(i)
                    size += len(parts[-1][0])
                if t and len(t) > 2 * passage - 2:
                    of_words.append(words_of(t))
                    word_at.append(i)
                    size += len(of_words[-1][0])
                if size > 100_000 or i == batch.num_rows - 1:
                    if parts:
                        yield block(parts, at, batch, ["upto"])
                    if of_words:
                        yield block(of_words, word_at, batch, ["upto"])
                    parts, at, of_words, word_at, size = [], [], [], [], 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of ``tokens`` and single for the parts of the runs that follow the texts."""
        for batch in batches:
            parts, at, size = [], [], 0
            for i, (t, found) in enumerate(zip(blobs(batch.column(1)), batch.column(3).to_pylist())):
                parts.append(part_tokens(t, found, length, min(PART, spread)))
                at.append(i)
                size += len(parts[-1][0])
                if size > 100_000 or i == batch.num_rows - 1:
                    yield block(parts, at, batch, ["single"])
                    parts, at, size = [], [], 0

    whole_run = (F.col("before") == 2) | (F.col("after") == 2)
    edge = (F.col("before") == 1) | (F.col("after") == 1)  # the first or last of its kind, and other kinds share the first token
    covered = F.struct(F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))

    least = min(length, 2 * passage - 1)
    suffixes = materialize(base.where(F.octet_length("text") >= least).mapInArrow(suffixes_of, tokens + ", upto int"))
    near = shared_with_neighbours(suffixes.where("lo IS NOT NULL"), ["core", "whole"], ["print", "lo"], F.col("upto") > F.col("hi"))
    same_words = shared_with_neighbours(suffixes.where("lo IS NULL").select("core", "whole", *row), ["core", "whole"], ["print"])
    discard(suffixes)
    repeated, all_of_them = whole_run | (F.col("upto") > F.col("hi")), F.struct(F.col("lo").alias("start"), (F.col("upto") + length).alias("end"))
    run = F.struct("anchor", "lo", "hi", (~repeated).alias("single"))
    nothing = [F.lit(None).cast(t) for t in ("struct<start: int, end: int>", "struct<anchor: int, lo: int, hi: int, single: boolean>")]
    told = near.select(*by_row, F.when(repeated, all_of_them).alias("span"), F.when(edge, run).alias("run"), F.lit(False).alias("shares"), F.lit(None).cast("long").alias("core")).union(
        same_words.select(*by_row, *nothing, whole_run, F.when(edge, F.col("core")))
    )
    told = told.groupBy("_key", "_print").agg(F.collect_set("span").alias("spans"), F.collect_set("run").alias("runs"), F.max("shares").alias("shares"), F.collect_set("core").alias("cores"))  # of one text: its copies tell the same
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    result = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *(["kept"] if texts else [])]
    schema = f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: int, end: int>>" + ", kept binary" * texts

    def drop(keys: pa.Array, bodies: list[bytes | None], spans: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
        """The columns of the result; those of a text that is still open, None, are null but for its spans."""
        out: list[list] = [[], [], [], [], [], []]
        for t, (start, end) in zip(bodies, spans):
            merged = _merged(start, end)
            rest, done = [], 0
            for s, e in merged if t is not None else ():
                rest.append(t[done:s])
                done = e
            rest = None if t is None else b"".join([*rest, t[done:]])
            got = (None, None, None, None) if t is None else (len(t), len(t) - len(rest), len(merged), hashlib.sha256(rest).hexdigest())
            for column, x in zip(out, (*got, [{"start": s, "end": e} for s, e in merged], rest)):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary())
        return [keys, *(pa.array(c, k) for c, k in zip(out, kinds))][: len(result)]

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Finish the texts without runs to look into; keep the others' texts. Windows of words are told of where runs of them are open."""
        bodies, open_runs, cores = blobs(batch.column(1)), batch.column(4), batch.column(6)
        is_open = [r.is_valid and len(r.values) > 0 for r in open_runs]
        cols = drop(batch.column(0), [None if o else t or b"" for o, t in zip(is_open, bodies)], _ends(batch.column(3)))
        kept = pa.array(is_open)
        texts_left = pa.compute.if_else(kept, batch.column(1), pa.scalar(None, batch.column(1).type))
        runs_left = pa.compute.if_else(kept, open_runs, pa.scalar(None, open_runs.type))
        windows = [passage_windows(t, np.asarray(c.values), passage, word_spread) if c.is_valid and len(c.values) else None for t, c in zip(bodies, cores)]
        return pa.RecordBatch.from_arrays([*cols, batch.column(2), texts_left, runs_left, batch.column(5), pa.array(windows, pa.list_(pa.int64()))], [*result, "print", "text", "runs", "shares", "windows"])

    joined = base.join(told, same_row, "left").select("key", "text", "print", "spans", "runs", "shares", "cores")
    settled = materialize(map_batches(joined, settle, schema + ", print long, text string, runs array<struct<anchor: int, lo: int, hi: int, single: boolean>>, shares boolean, windows array<long>"))
    still = settled.where("text IS NOT NULL")
    open_windows = materialize(settled.where("windows IS NOT NULL").select(*row, F.explode("windows").alias("core")))
    also = shared_with_neighbours(open_windows, ["core"], ["print"]).select(*by_row, F.lit(True).alias("also")).distinct()

    parts = materialize(still.select("key", "text", "print", "runs").mapInArrow(cut, tokens + ", single boolean"))
    near = shared_with_neighbours(parts, ["core", "whole"], ["print", "lo"])
    found = near.where(F.col("single") & whole_run).select(*row, covered.alias("span"))
    partly = near.where(edge).groupBy(*by_row).agg(F.collect_set(F.struct("lo", "hi", (F.col("single") & ~whole_run).alias("single"))).alias("parts"))  # of one text

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (t, found) in enumerate(zip(blobs(batch.column(1)), batch.column(3).to_pylist())):
                data = np.frombuffer(t, np.uint8)
                at = np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in found])
                one = np.concatenate([np.full(r["hi"] - r["lo"] + 1, r["single"]) for r in found])
                rows = pa.array(np.full(len(at), i))
                h = [pa.array(Hashes(data, k).of(at, at + length).view(np.int64)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*h, batch.column(0).take(rows), batch.column(2).take(rows), pa.array(at.astype(np.int32)), pa.array(one)], ["h0", "h1", *row, "lo", "single"])

    windows = still.join(partly, same_row).select("key", "text", "print", "parts").mapInArrow(expand, f"h0 long, h1 long, key {kind}, print long, lo int, single boolean")
    met = shared_with_neighbours(materialize(windows), ["h0", "h1"], ["print", "lo"]).withColumn("hi", F.col("lo")).where(F.col("single") & whole_run)
    marks = found.union(met.select(*row, covered.alias("span"))).groupBy(*by_row).agg(F.collect_set("span").alias("more"))  # of one text

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [tuple(np.r_[x, y] for x, y in zip(a, b)) for a, b in zip(_ends(batch.column(2)), _ends(batch.column(3)))]
        return pa.RecordBatch.from_arrays([*drop(batch.column(0), blobs(batch.column(1)), spans), batch.column(4), batch.column(5)], [*result, "print", "shares"])

    finished = map_batches(still.join(marks, same_row, "left").select("key", "text", "spans", "more", "print", "shares"), finish, schema + ", print long, shares boolean")
    done = settled.where("text IS NULL").select(*result, "print", "shares").union(finished).join(also, same_row, "left")
    return done.select(*result, (F.coalesce("shares", F.lit(False)) | F.col("also").isNotNull()).alias("shares_passage")).withColumnRenamed("key", key)


def oracle(length: int = LENGTH, passage: int = PASSAGE) -> str:
    """The query over table ``documents`` for DuckDB: every window by its digest."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, md5_number(b[i:i + {length - 1}]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - {length - 2})) AS i FROM d WHERE octet_length(b) >= {length})),
m AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
n AS (SELECT r, i, i > lag(i, 1, -{length}) OVER (PARTITION BY r ORDER BY i) + {length} AS new FROM m),
s AS (SELECT r, min(i) AS s, max(i) + {length} AS e FROM (SELECT r, i, count_if(new) OVER (PARTITION BY r ORDER BY i) AS k FROM n) GROUP BY r, k),
g AS (SELECT r, s, e, lag(e, 1, 1) OVER (PARTITION BY r ORDER BY s) AS upto FROM s),
k AS (SELECT r, sum(e - s) AS n_removed, count(*) AS n_spans, string_agg(CASE WHEN s > upto THEN hex(b[upto:s - 1]) ELSE '' END, '' ORDER BY s) || CASE WHEN max(e) <= max(octet_length(b)) THEN hex(any_value(b)[max(e):]) ELSE '' END AS kept
  FROM g JOIN d USING (r) GROUP BY r),
v AS (SELECT r, regexp_extract_all(decode(b), '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
p AS (SELECT DISTINCT r, md5_number(array_to_string(ws[i:i + {passage - 1}], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - {passage - 2})) AS i FROM v WHERE len(ws) >= {passage})),
q AS (SELECT DISTINCT r FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1))
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, CASE WHEN kept IS NULL THEN sha256(b) ELSE sha256(unhex(kept)) END AS kept_sha256,
  q.r IS NOT NULL AS shares_passage
FROM d LEFT JOIN k USING (r) LEFT JOIN q USING (r)"""
