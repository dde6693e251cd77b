"""Periodic runs of words, by the suffix tree of each text.

A run is a stretch of words that repeats with a period and that no neighbour extends. Texts of a batch are
numbered word by word, each text with numbers of its own and a last number that occurs nowhere else, so that one
generalised suffix tree holds them all and no match crosses texts. Prefix doubling sorts the suffixes and gives the lengths that
neighbours share; the tree's inner nodes are the intervals of suffixes that share a prefix, found by one
scan with a stack.

After Stoye and Gusfield, a node of depth d is a branching tandem repeat's half where two of its leaves are d words
apart and go on differently; of any two such leaves one is outside the node's largest child, so only
the leaves of the smaller children are walked, n log n in all. Each run ends in just one branching repeat of its
period: rotating that to the left as far as words stay equal gives the run. Repeats of the same
stretch with a multiple of the period are merged into it.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paychain.llm.common import with_columns

#: A run's words at least, and its periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of the texts that share a tree, about; a longer text has one of its own.
TREE_WORDS = 1 << 16


class SuffixTree:
    """Of numbers that end in one that occurs once, as do all texts among them: sorted suffixes, shared lengths, and ranks by leading 1, 2, 4, … numbers."""

    def __init__(self, numbers: np.ndarray):
        self.numbers, n = numbers, len(numbers)
        self.order = order = np.argsort(numbers, kind="stable")
        head = np.ones(n, bool)
        head[1:] = np.diff(numbers[order]) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
        self.levels, self.shared, h = [rank], np.zeros(n, np.int64), 1
        self.head = head
        alone = head & np.append(head[1:], True)
        open_ = np.flatnonzero(~alone)
        while len(open_):
            at = order[open_]
            both = rank[at] * n + rank[at + h]
            by = np.argsort(both, kind="stable")
            order[open_], both = at[by], both[by]
            new = np.ones(len(open_), bool)
            new[1:] = np.diff(both) != 0
            apart = open_[new & (open_ != rank[at])]  # groups that were one before
            self.shared[apart] = h + self.alike(order[apart - 1] + h, order[apart] + h)
            rank = rank.copy()
            rank[order[open_]] = open_[new][np.cumsum(new) - 1]
            self.levels.append(rank)
            open_ = open_[~(new & np.append(new[1:], True))]
            h *= 2
        self.rank = rank

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers from ``a`` on and from ``b`` on are equal, less than twice what the last level tells."""
        a, b, n = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step = np.where(self.levels[k][a] == self.levels[k][b], 1 << k, 0)
            a, b, n = a + step, b + step, n + step
        return n

    def alike_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers before ``a`` and before ``b`` are equal, for a < b."""
        a, b, n = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            left, right = a - (1 << k), b - (1 << k)
            step = np.where((left >= 0) & (self.levels[k][np.maximum(left, 0)] == self.levels[k][np.maximum(right, 0)]), 1 << k, 0)
            a, b, n = a - step, b - step, n + step
        return n

    def nodes(self, leaves: int) -> np.ndarray:
        """Inner nodes with so many leaves at least: depth, first and last leaf, and first and last leaf of the largest child."""
        firsts = np.flatnonzero(self.head)
        sizes = np.diff(np.append(firsts, len(self.head)))
        found: list[tuple[int, int, int, int, int]] = []
        for first, size in zip(firsts[sizes >= leaves].tolist(), sizes[sizes >= leaves].tolist()):  # suffixes with the same first number
            stack: list[list[int]] = [[0, first, first, first]]
            for at, depth in enumerate([*self.shared[first + 1 : first + size].tolist(), 0], first):
                lo = hi = at  # the child that ends here
                while stack[-1][0] > depth:
                    d, left, big, big_end = stack.pop()
                    if hi - lo > big_end - big:
                        big, big_end = lo, hi
                    if at - left + 1 >= leaves:
                        found.append((d, left, at, big, big_end))
                    lo, hi = left, at
                if stack[-1][0] < depth:
                    stack.append([depth, lo, lo, hi])
                elif hi - lo > stack[-1][3] - stack[-1][2]:
                    stack[-1][2:] = lo, hi
        return np.array(found, np.int64).reshape(-1, 5)


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and each number of it, for the ranges first to last (last < first: none)."""
    n = np.maximum(last - first + 1, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]


def runs_of(numbers: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """(start, end, period) of all runs, by start and period; two periods are the least that can be asked for."""
    tree = SuffixTree(numbers)
    depth, first, last, big, big_end = tree.nodes(least_periods).T
    which, leaf = (np.concatenate(x) for x in zip(_spread(first, big - 1), _spread(big_end + 1, last)))
    at, d, n = tree.order[leaf], depth[which], len(numbers)

    def under(leaf_at: np.ndarray) -> np.ndarray:
        inside = (leaf_at >= 0) & (leaf_at < n)
        rank = tree.rank[np.where(inside, leaf_at, 0)]
        return inside & (rank >= first[which]) & (rank <= last[which])

    found = []
    for start, other in ((at, at + d), (at - d, at - d)):  # the walked leaf begins the repeat, or its second half
        good = under(other)
        for k in range(1, least_periods - 1):  # what ends here has all its periods under the same node
            good[good] &= under(start - k * d)[good]
        good &= start >= 0
        s, p = start[good], d[good]
        goes_on = numbers[s + p] == numbers[s + 2 * p]
        found.append(np.stack([s[~goes_on], p[~goes_on]]))
    s, p = np.unique(np.concatenate(found, 1), axis=1)
    end = s + 2 * p
    s = s - tree.alike_before(s, s + p)
    by = np.lexsort((p, end, s))
    s, end, p = s[by], end[by], p[by]
    same = np.zeros(len(s), bool)
    same[1:] = (np.diff(s) == 0) & (np.diff(end) == 0)  # a multiple of the period before
    keep = ~same & (end - s >= np.maximum(least_words, least_periods * p))
    s, end, p = s[keep], end[keep], p[keep]
    by = np.lexsort((p, s))
    return np.stack([s[by], end[by], p[by]], 1)


def _collapse(texts: list[bytes | None], least_words: int, least_periods: int) -> list[tuple[int, list[dict], dict | None, bytes]]:
    """Number of words, runs, the strongest run and the collapsed text of each; texts share trees up to ``TREE_WORDS``."""
    out: list[tuple[int, list[dict], dict | None, bytes]] = []
    words: list[list[bytes]] = []
    numbers: list[list[int]] = []
    used = size = 0

    def flush() -> None:
        nonlocal words, numbers, used, size
        starts = np.cumsum([0, *(len(x) for x in numbers)])
        found = runs_of(np.concatenate([np.array(x, np.int64) for x in numbers]), least_words, least_periods)
        mine = np.searchsorted(starts, found[:, 0], "right") - 1
        bounds = np.searchsorted(mine, np.arange(len(words) + 1))
        for i, w in enumerate(words):
            own = found[bounds[i] : bounds[i + 1]] - np.array([starts[i], starts[i], 0])
            runs = [{"start": s, "length": e - s, "period": p} for s, e, p in own.tolist()]
            best = max(runs, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]), default=None)
            if runs:
                covered = np.zeros(len(w) + 1, np.int64)
                np.add.at(covered, own[:, 0] + own[:, 2], 1)
                np.add.at(covered, own[:, 1], -1)
                kept = b" ".join([w[k] for k in np.flatnonzero(np.cumsum(covered[:-1]) == 0).tolist()])
            else:
                kept = b" ".join(w)
            out.append((len(w), runs, best, kept))
        words, numbers, used, size = [], [], 0, 0

    for t in texts:
        w = (t or b"").split()
        ids: dict[bytes, int] = {}
        own = [ids.setdefault(x, used + len(ids)) for x in w]
        used += len(ids)
        own.append(used)
        used += 1
        words.append(w)
        numbers.append(own)
        size += len(own)
        if size >= TREE_WORDS:
            flush()
    if words:
        flush()
    return out


def find_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """``keep`` columns (all by default) and n_words, runs, strongest, collapsed of each whole text.

    Words are separated by ASCII white space and numbered from 0. runs: array<struct<start, length, period>>, all maximal
    runs of at least ``least_words`` words and ``least_periods`` (2 or more) times their smallest period, by start and period.
    strongest: the one with the greatest length/period, compared exactly (ties: smallest start, then period), null without
    runs. collapsed: the words, joined by one space, but for those that a run holds after its first period. Null and empty
    texts have no words and collapse to the empty text; repeated rows are each judged. A text of n words takes 8 n bytes for each
    doubling of its longest repeat. Columns of the same names as the new ones give way to them.
    """
    if least_periods < 2:
        raise ValueError("a run has at least two periods")
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def scan(texts: list[bytes | None], _) -> list:
        n, runs, best, kept = zip(*_collapse(texts, least_words, least_periods))
        return [pa.array(n, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(best, run), pa.array(kept, pa.binary()).cast(pa.string())]

    shape = "struct<start: bigint, length: bigint, period: bigint>"
    return with_columns(docs, docs.columns if keep is None else keep, text, scan, f"n_words long, runs array<{shape}>, strongest {shape}, collapsed string", ["n_words", "runs", "strongest", "collapsed"])


def oracle(least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> str:
    """The query over table ``documents`` for DuckDB: all pairs of equal words of a text that a period can have apart."""
    return f"""
WITH tab AS (SELECT list(list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS tab FROM range(256) AS r(n)),
t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, coalesce(doc_id::VARCHAR, '') AS key FROM documents),
h AS (SELECT r, doc_id, w, len(w)::BIGINT AS n, xor(4294967295, list_reduce(list_transform(range(len(key)), lambda i: ascii(key[i + 1])::BIGINT), lambda c, v: xor(c >> 8, tab[1 + (xor(c, v) & 255)]), 4294967295)) AS h FROM t, tab),
g AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g),
d AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p),
e AS (SELECT r, n, unnest(w) AS x, unnest(range(n)) AS i FROM d),
m AS (SELECT u.r, u.i, v.i - u.i AS q FROM e u JOIN e v ON u.r = v.r AND u.x = v.x AND v.i > u.i AND (v.i - u.i) * {least_periods} <= u.n),
s AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m),
l AS (SELECT r, min(i) AS start, count(*) + q AS length, q FROM s GROUP BY r, q, island),
runs AS (SELECT r, start, length, min(q) AS period FROM l GROUP BY r, start, length HAVING length >= greatest({least_words}, {least_periods} * min(q))),
told AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM runs GROUP BY r),
best AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM runs),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS kept FROM e ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (r) LEFT JOIN (FROM best WHERE k = 1) USING (r) LEFT JOIN kept USING (r)"""
