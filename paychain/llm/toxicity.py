"""Toxicity by maximum-scoring segments.

Each token has a log-odds score of toxic against clean labelled documents, each counting a token
once, under an informative Dirichlet prior (the token's share of both). Only log-odds beyond ``Z`` standard
deviations count, of toxic and of clean tokens; every token that is not toxic costs a little, and a clean one its log-odds besides. A linear-time scan finds all maximal
segments of positive total. Under clean text the best segment of n tokens follows an
extreme-value law, whose scale comes from the token scores themselves; a segment that chance
would rarely bring forth is a toxic passage. The document's score is that extreme value put
on a probability scale by logistic calibration, for which each part of the sample is scored by what the other parts taught.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paychain.llm.common import discard, materialize, small_batches, with_columns

#: Bounds of what is learned from: labelled rows, and tokens kept of the lexicon, of either sign.
SAMPLE_ROWS, MAX_LEXICON = 16_384, 20_000
#: Parts of the sample for the calibration, and tasks that read it.
FOLDS, SAMPLE_TASKS = 4, 16
#: Weight of the prior against the data, deviations beyond chance, cost of other tokens, chance level of a passage.
PRIOR, Z, COST, SIGNIFICANT = 0.1, 2.7, 0.5, 0.01

#: Upper-case letters become lower-case; ASCII that is neither letter nor digit becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[bytes, float] = field(default_factory=dict)  # toxic tokens above zero, clean ones below
    scale: float = 1.0  # lambda of the extreme-value law
    shift: float = 0.0  # logarithm of its K
    slope: float = 1.0
    offset: float = -2.0


def segments(scores: list[tuple[int, float]], n: int, cost: float = COST) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of n tokens; ``scores`` has those of the lexicon by place, others cost ``cost``.

    The linear-time scan of Ruzzo and Tompa: candidates keep the running total before and after them;
    a new one joins the last candidate whose total before is less and after no more than its own.
    """
    done: list[list] = []
    out: list[list] = []  # start, end, total before, total after, the last candidate with less before
    total, at_end = 0.0, 0
    for at, s in scores:
        total -= cost * (at - at_end)
        if s <= 0:
            total, at_end = total + s, at + 1
            continue
        new = [at, at + 1, total, total + s, -1]
        total += s
        at_end = at + 1
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j = out[j][4]
            if j < 0:  # the total has never been so low: nothing before joins anything after
                done += out
                out = []
                break
            if out[j][3] >= new[3]:
                break
            new[0], new[2] = out[j][0], out[j][2]
            del out[j:]
        new[4] = j
        out.append(new)
    return [(a, b, r - l) for a, b, l, r, _ in done + out]


def _scored(text: bytes, lexicon: dict[bytes, float], toxic: set[bytes]) -> tuple[int, list[tuple[int, float]]]:
    """How many tokens a text has, and those of the lexicon by place; none without a ``toxic`` one, as no segment is positive then."""
    tokens = text.translate(_FOLD).split()
    if toxic.isdisjoint(tokens):
        return len(tokens), []
    return len(tokens), [(i, lexicon[t]) for i, t in enumerate(tokens) if t in lexicon]


def _toxic(lexicon: dict[bytes, float]) -> set[bytes]:
    return {t for t, s in lexicon.items() if s > 0}


def _best(text: bytes | None, lexicon: dict[bytes, float], toxic: set[bytes]) -> tuple[float, int]:
    n, scores = _scored(text or b"", lexicon, toxic)
    return max((s for _, _, s in segments(scores, n)), default=0.0), n


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", toxic: str = "toxic", usable: Column | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 11
) -> ToxicityModel:
    """Learn from at most ``sample_rows`` labelled keys, chosen by a hash of the key, and as many of their texts.

    Labels count if ``usable`` (on the labels' columns) holds and key and label are not null; a key with several
    labels takes the largest. The token scores are those of the whole sample; for the calibration the sample is dealt into ``FOLDS`` parts, and each
    part's texts are scored by tokens that only the other parts gave. Without labels of both kinds the model finds nothing and scores every text alike.
    """
    small_batches(docs.sparkSession)
    chosen = (
        labels.where(usable if usable is not None else F.lit(True)).where(F.col(key).isNotNull() & F.col(toxic).isNotNull())
        .groupBy(F.col(key).alias("_key")).agg(F.max(toxic).cast("int").alias("_toxic"))
        .withColumn("_draw", F.xxhash64(F.lit(seed), "_key")).orderBy("_draw", "_key").limit(sample_rows)
        .select("_key", "_toxic", F.pmod("_draw", F.lit(FOLDS)).cast("int").alias("_part"))
    )
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")  # sample_rows rows at most
    order = F.xxhash64(F.lit(seed), "_key", "_text")  # rows that repeat a key count, but no more than the bound
    rows = materialize(rows.withColumn("_order", order).orderBy("_order", "_key").limit(sample_rows).repartition(SAMPLE_TASKS, "_key").drop("_order", "_key"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many texts of each part and kind hold a token."""
        found: dict[bytes, list[int]] = {}
        for batch in batches:
            for t, toxic, part in zip(*(c.to_pylist() for c in batch.columns)):
                if t:
                    for w in set(t.encode("utf-8", "replace").translate(_FOLD).split()):
                        found.setdefault(w, [0] * (2 * FOLDS))[2 * part + (toxic > 0)] += 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.list_(pa.int64()))], ["token", "n"])

    every = range(FOLDS + 1)  # the last is the model of all parts
    counts = rows.select("_text", "_toxic", "_part").mapInArrow(count, "token binary, n array<long>")
    total = lambda k: F.coalesce(F.sum(F.get("n", F.lit(k))), F.lit(0))
    counts = counts.groupBy("token").agg(*(total(2 * p + y).alias(f"{kind}{p}") for p in range(FOLDS) for y, kind in enumerate(("clean", "toxic"))))

    def but(kind: str, f: int) -> Column:
        return sum((F.col(f"{kind}{p}") for p in range(FOLDS) if p != f), F.lit(0))

    counts = materialize(counts.select("token", *(but(kind, f).alias(f"{kind}_{f}") for f in every for kind in ("clean", "toxic"))))
    sums = counts.agg(*(F.coalesce(F.sum(f"{kind}_{f}"), F.lit(0)) for f in every for kind in ("clean", "toxic"))).first()
    sizes = [(sums[2 * f], sums[2 * f + 1]) for f in every]
    if not all(sizes[FOLDS]):
        return ToxicityModel()
    every = [f for f in every if all(sizes[f])]  # a part may have all that is of a kind

    def significant(table: DataFrame) -> dict[int, list]:
        """Of each model, the tokens that are more frequent in one kind beyond chance, the most certain ones of each kind first."""

        def told(f: int) -> Column:
            n_clean, n_toxic = sizes[f]
            weight, clean, toxic = PRIOR * (n_clean + n_toxic), F.col(f"clean_{f}"), F.col(f"toxic_{f}")
            prior = PRIOR * (clean + toxic)
            odds = lambda y, n: F.log((y + prior) / (n + weight - y - prior))
            delta, error = odds(toxic, n_toxic) - odds(clean, n_clean), F.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
            sign = F.when((toxic > 1) & (delta > Z * error), 1).when((clean > 1) & (-delta > Z * error), -1)
            return F.when(clean + toxic > 1, F.struct(F.lit(f).alias("f"), sign.alias("sign"), clean.alias("clean"), toxic.alias("toxic"), delta.alias("delta"), error.alias("error")))

        some = table.select("token", F.explode(F.array(*map(told, every))).alias("r")).select("token", "r.*").where("sign IS NOT NULL")
        best = Window.partitionBy("f", "sign").orderBy((F.col("sign") * F.col("delta") / F.col("error")).desc(), "token")
        found: dict[int, list] = {f: [] for f in every}
        for r in some.withColumn("place", F.row_number().over(best)).where(F.col("place") <= MAX_LEXICON).orderBy("f", F.desc("sign"), "place").collect():
            found[r["f"]].append(r)
        return found

    # copies of one text repeat its words: tokens count again by the words around their first place, each pair once
    hopeful = {f: {bytes(r["token"]) for r in rows_} for f, rows_ in significant(counts).items()}
    discard(counts)
    any_of_them = set().union(*hopeful.values())

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple[bytes, bytes, int, int]] = set()
            for t, toxic, part in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = [b"", *t.encode("utf-8", "replace").translate(_FOLD).split(), b""] if t else []
                first: dict[bytes, int] = {}
                for i, w in enumerate(tokens):
                    if w in any_of_them:
                        first.setdefault(w, i)
                out.update((w, tokens[i - 1] + b" " + tokens[i + 1], int(toxic > 0), 1 << part) for w, i in first.items())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.binary(), pa.int32(), pa.int32()))], ["token", "pair", "toxic", "parts"])

    pairs = rows.select("_text", "_toxic", "_part").mapInArrow(around, "token binary, pair binary, toxic int, parts int").groupBy("token", "pair", "toxic").agg(F.bit_or("parts").alias("parts"))
    others = lambda f: F.col("parts").bitwiseAND(F.lit(((1 << FOLDS) - 1) & ~(1 << f))) > 0
    again = pairs.groupBy("token").agg(*(F.count_if((F.col("toxic") == y) & others(f)).alias(f"{kind}_{f}") for f in every for y, kind in enumerate(("clean", "toxic"))))
    top = significant(materialize(again)) if any_of_them else {f: [] for f in every}
    models = {}
    for f in every:
        found = [r for r in top[f] if bytes(r["token"]) in hopeful[f]]
        lexicon = {bytes(r["token"]): r["delta"] - r["error"] if r["delta"] > 0 else r["delta"] + r["error"] - COST for r in found}
        # the scale solves E[exp(scale * score)] = 1 over clean tokens
        shares = [((r["clean"] + 0.5) / sizes[f][0], lexicon[bytes(r["token"])]) for r in found]
        rest = 1 - sum(p for p, _ in shares)
        low, high = 1e-6, 50.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (low, mid) if rest * math.exp(-COST * mid) + sum(p * math.exp(min(700, mid * s)) for p, s in shares) > 1 else (mid, high)
        models[f] = lexicon, _toxic(lexicon), min(low, 5.0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best segment of each text by the tokens of the other parts."""
        for batch in batches:
            got = [(*_best(t.encode("utf-8", "replace") if t else None, *models[p][:2]), y, p) for t, y, p in zip(*(c.to_pylist() for c in batch.columns)) if p in models]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), (pa.float64(), pa.int64(), pa.int32(), pa.int32()))], ["best", "n", "toxic", "part"])

    held = rows.select("_text", "_toxic", "_part").mapInArrow(measure, "best double, n long, toxic int, part int").toArrow()  # a row for each of the sample
    discard(rows)
    best, n, y, part = (np.asarray(held.column(c)).astype(float) for c in ("best", "n", "toxic", "part"))
    clean = (y == 0) & (best > 0)
    shift = float(np.log(max(clean.sum(), 1) / max(n[y == 0].sum(), 1))) if len(y) else 0.0
    scales = np.array([models[int(p)][2] for p in part])
    x = np.maximum(_extreme(best, n, scales, shift), -5)
    slope, offset = _logistic(np.minimum(x, 60), y) if len(set(y.tolist())) > 1 else (0.5, -2.0)
    lexicon, _, scale = models[FOLDS]
    return ToxicityModel(lexicon, scale, shift, slope, offset)


def _extreme(best: np.ndarray, n: np.ndarray, scale: float | np.ndarray, shift: float) -> np.ndarray:
    """How far the best segment is beyond what chance brings: minus the logarithm of its expected number in n tokens."""
    return np.where(best > 0, scale * best - shift - np.log(np.maximum(n, 1)), -5.0)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a small ridge and softened labels."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    X, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ w))
        step = np.linalg.solve(X.T @ (X * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), X.T @ (t - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default), score (0 to 1) and passages of each whole text.

    passages: array<struct<start, end, weight>>, every maximal segment that less than one in a hundred clean texts of
    that length would hold, in code points. Null and empty texts have no passage and the score of a text without
    any toxic token. Columns of the same names as the new ones give way to them.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.scale, model.shift, model.slope, model.offset))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))

    def scan(texts: list[bytes | None], _) -> list:
        lexicon, scale, shift, slope, offset = shared.value
        scores, passages, bad = [], [], _toxic(lexicon)
        for t in texts:
            n, hits = _scored(t or b"", lexicon, bad)
            found = segments(hits, n)
            best = max((s for _, _, s in found), default=0.0)
            x = min(60.0, max(-5.0, float(_extreme(np.float64(best), np.float64(n), scale, shift))))
            scores.append(1 / (1 + math.exp(-(slope * x + offset))))
            bar = (shift + math.log(max(n, 1)) - math.log(SIGNIFICANT)) / scale
            found = [f for f in found if f[2] >= bar]
            if found:
                at = [m.span() for m in _WORD.finditer(t.decode("utf-8", "replace"))]
                passages.append([{"start": at[a][0], "end": at[b - 1][1], "weight": s} for a, b, s in found])
            else:
                passages.append([])
        return [pa.array(scores, pa.float64()), pa.array(passages, kind)]

    return with_columns(docs, docs.columns if keep is None else keep, text, scan, "score double, passages array<struct<start: int, end: int, weight: double>>", ["score", "passages"])
