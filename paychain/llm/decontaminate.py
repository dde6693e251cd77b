"""Benchmark decontamination with a generalised suffix automaton.

All test items, as word sequences, go into one suffix automaton. Document words stream through it;
the automaton keeps the longest suffix read so far that occurs in any item. Where that reaches the
window length, the last words are a window of some item.

Words that no item holds reset the automaton to its root, so only runs of known words that are as
long as the shortest window are streamed at all.

The items are cut into pieces that overlap by all but one word of a window and dealt over blocks of bounded
size. A task builds the automaton of a block and writes it to the shared folder; the tasks of the documents
read these files in turn, so neither items nor automata pass through the driver and the documents are read once.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paychain.llm.common import blobs, map_batches, shared_dir, with_columns

WINDOW = 10
#: Words of items in one automaton (some 50 MB) and in a piece of an item; automata that a task keeps where there are few, else
#: documents for which it reads each of them.
BLOCK_WORDS, PIECE_WORDS, KEPT, READ_FOR = 100_000, 10_000, 2, 20_000

#: Upper-case letters become lower-case, what is no word byte becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def build(items: list[tuple[str, list[bytes]]], window: int) -> tuple:
    """The automaton of (item id, words): vocabulary, moves, lengths, links, window states, what ends where, nearest ends, shortest window."""
    vocabulary: dict[bytes, int] = {}
    moves, length, link = [{}], [0], [-1]

    def add(state: int, c: int) -> int:
        q = moves[state].get(c)
        if q is not None and length[q] == length[state] + 1:
            return q
        if q is None:
            cur = len(moves)
            moves.append({})
            length.append(length[state] + 1)
            link.append(0)
            p = state
            while p >= 0 and c not in moves[p]:
                moves[p][c] = cur
                p = link[p]
            if p < 0:
                return cur
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
                return cur
        else:
            cur, p = -1, state
        clone = len(moves)
        moves.append(dict(moves[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p >= 0 and moves[p].get(c) == q:
            moves[p][c] = clone
            p = link[p]
        link[q] = clone
        if cur < 0:
            return clone
        link[cur] = clone
        return cur

    coded = [(name, [vocabulary.setdefault(w, len(vocabulary)) for w in ws]) for name, ws in items if ws]
    for _, ws in coded:
        state = 0
        for c in ws:
            state = add(state, c)
    held = [0] * len(moves)  # the suffix state of `window` words
    for v in sorted(range(len(moves)), key=length.__getitem__):
        if length[v] >= window:
            held[v] = v if length[link[v]] < window else held[link[v]]
    owners: dict[int, set[str]] = {}
    ends: dict[int, list[tuple[int, str]]] = {}
    for name, ws in coded:
        state = 0
        for i, c in enumerate(ws, 1):
            state = moves[state][c]
            if i >= window:
                owners.setdefault(held[state], set()).add(name)
        if len(ws) < window:
            ends.setdefault(state, []).append((len(ws), name))
    ending = [0] * len(moves)  # the nearest suffix state that ends an item of fewer words: none is walked in vain
    for v in sorted(range(1, len(moves)), key=length.__getitem__) if ends else ():
        ending[v] = v if v in ends else ending[link[v]]
    return vocabulary, moves, length, link, held, owners, ends, ending, min((min(len(ws), window) for _, ws in coded), default=0)


def stream(tokens: list[bytes], automaton: tuple, window: int, hit: bytearray, names: set[str]) -> None:
    """Mark in ``hit`` each word in an occurrence of a window and add the items to ``names``."""
    vocabulary, moves, length, link, held, owners, ends, ending, least = automaton
    if not least:
        return
    known = bytes(map(vocabulary.__contains__, tokens))
    need, at = b"\1" * least, 0
    while (at := known.find(need, at)) >= 0:
        stop = known.find(b"\0", at)
        stop = len(known) if stop < 0 else stop
        state = n = 0
        for i in range(at, stop):
            c = vocabulary[tokens[i]]
            while state and c not in moves[state]:
                state = link[state]
                n = length[state]
            nxt = moves[state].get(c)
            if nxt is None:
                continue
            state = nxt
            n += 1
            if n >= window:
                hit[i - window + 1 : i + 1] = b"\1" * window
                names |= owners[held[state]]
            if ends:
                v = ending[state]
                while v > 0:  # items of fewer words than a window: as many steps at most
                    for m, name in ends[v]:
                        if m <= n:
                            hit[i - m + 1 : i + 1] = b"\1" * m
                            names.add(name)
                    v = ending[link[v]]
        at = stop


def _spans(text: str, hit: bytearray) -> list[dict]:
    """Code-point spans from the first to the last word of each run of hit words."""
    out: list[dict] = []
    for k, m in enumerate(_WORD.finditer(text)):
        if hit[k]:
            if k and hit[k - 1]:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
    return out


def write_automata(benchmark: DataFrame, item: str, text: str, window: int) -> list[str]:
    """The files of the automata of all items, one for each block."""
    folder = f"{shared_dir(benchmark.sparkSession)}/automata-{uuid.uuid4().hex}"

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, pieces, sizes = [], [], []
        for name, t in zip(batch.column(0).to_pylist(), blobs(batch.column(1))):
            ws = words(t)
            for s in range(0, max(1, len(ws) - window + 1), PIECE_WORDS):
                piece = ws[s : s + PIECE_WORDS + window - 1]
                if piece:
                    names.append(name or ""), pieces.append(b" ".join(piece)), sizes.append(len(piece))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pieces, pa.binary()), pa.array(sizes, pa.int64())], ["item", "piece", "n"])

    pieces = map_batches(benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")), cut, "item string, piece binary, n long").distinct()
    total = pieces.agg(F.sum("n")).first()[0] or 0
    block = F.pmod(F.xxhash64("item", "piece"), F.lit(-(-total // BLOCK_WORDS) or 1)).cast("int")

    def write(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("item").to_pylist(), group.column("piece").to_pylist()))
        store, top = pafs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        name = f"{uuid.uuid4().hex}.automaton"  # a task that runs again writes another file
        with store.open_output_stream(f"{top}/{name}", compression=None) as out:
            out.write(pickle.dumps(build([(i, p.split()) for i, p in rows], window)))
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "name": [name]})

    written = pieces.withColumn("block", block).groupBy("block").applyInArrow(write, "block int, name string")
    return [f"{folder}/{r['name']}" for r in sorted(written.collect())]  # one row for each block


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None
) -> DataFrame:
    """``keep`` columns (all by default) and n_words, n_hit, items (ids in string order), spans (code points) of each whole text.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window, one of
    none has none. Null and empty texts have no words; an item whose id is null has the empty id, and rows
    that repeat an item id are one item. An empty benchmark contaminates nothing. Repeated documents are
    scanned each; columns of the same names as the new ones give way to them.
    """
    names = ["n_words", "n_hit", "items", "spans"]
    added = "n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    files, kept = write_automata(benchmark, item, item_text, window), {}

    def automaton(file: str) -> tuple:
        if file in kept:
            return kept[file]
        store, path = pafs.FileSystem.from_uri(file)
        with store.open_input_stream(path) as f:
            found = pickle.loads(f.read())
        if len(files) <= KEPT:
            kept[file] = found
        return found

    def scan(texts: list[bytes | None], _) -> list:
        n_words, hits, items = [0] * len(texts), [bytearray()] * len(texts), [set() for _ in texts]
        for place, file in enumerate(files or [None]):
            block = automaton(file) if file else build([], window)
            for k, t in enumerate(texts):
                tokens = words(t)
                if not place:
                    n_words[k], hits[k] = len(tokens), bytearray(len(tokens))
                stream(tokens, block, window, hits[k], items[k])
        spans = [_spans(t.decode("utf-8", "replace"), hit) if got else [] for t, hit, got in zip(texts, hits, items)]
        return [pa.array(n_words, pa.int64()), pa.array([sum(h) for h in hits], pa.int64()), pa.array([sorted(i) for i in items], pa.list_(pa.string())), pa.array(spans, kind)]

    rows = 1 if len(files) <= KEPT else READ_FOR  # files that aren't kept are read again and again
    return with_columns(docs, docs.columns if keep is None else keep, text, scan, added, names, rows)
