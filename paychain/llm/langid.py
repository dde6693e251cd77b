"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its letter n-grams (one to four code points of lower-cased
words, hashed into buckets); a linear softmax over that mean gives the language. The embeddings and
the softmax are trained together by stochastic gradient descent in numpy on a bounded sample of
labelled rows. As the model is linear after the mean, buckets x languages logits are all that a
task needs to predict with.

Confidence is calibrated on labelled rows that training doesn't see: a temperature by likelihood and
two rejection levels, which at most ``reject_share`` of those rows fall under: one of the probability, and one of
how likely a text's n-grams are in the language found. A text of no learned language may still be much nearer
to one of them than to the others, so the probability alone doesn't tell it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from paychain.llm.common import map_batches, with_columns

BUCKETS, DIM, GRAMS = 1 << 15, 16, 4
#: Bounds of the sample: labelled texts of each language, and of all, shared among the languages where they are many.
ROWS_PER_LANGUAGE, ROWS, LEAST_ROWS = 600, 120_000, 20
#: Of an n-gram's probability in a language, the share that all buckets have alike.
SMOOTHED = 0.01
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    logits: np.ndarray  # BUCKETS x languages, float32
    temperature: float
    reject_below: float
    likely: np.ndarray  # BUCKETS x languages, float32: log-probabilities
    usual: np.ndarray  # of each language, the mean log-probability that its texts have in the middle
    steady: float  # n-grams at which a text's own manner counts as much as chance
    unlike_below: float


def _unlike(mean: np.ndarray, usual: np.ndarray, n: np.ndarray, steady: float) -> np.ndarray:
    """How far texts of n n-grams are from the usual likelihood, on one scale for all lengths."""
    return (mean - usual) / np.sqrt(1 / n + 1 / steady)


def buckets_of(text: str) -> np.ndarray | None:
    """Buckets of all n-grams of a text's words; None if it has no letter."""
    low = text.lower()
    codes = np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32)
    if not len(codes):
        return None
    # ASCII by table, others by Python's own notion of a letter, once for each distinct one
    letter = ((codes >= 97) & (codes <= 122)) | (codes >= 128)
    other = np.unique(codes[codes >= 128])
    if wrong := [c for c in other.tolist() if not chr(c).isalpha()]:
        letter &= ~np.isin(codes, wrong)
    if not letter.any():
        return None
    x = np.where(letter, codes, 32).astype(np.uint64)
    keep = np.ones(len(x), bool)
    keep[1:] = letter[1:] | letter[:-1]  # one space between words
    x = np.concatenate([[np.uint64(32)], x[keep], [np.uint64(32)]])
    space = x == 32
    out, h = [], np.zeros(len(x), np.uint64)
    for n in range(1, GRAMS + 1):
        if len(x) < n:
            break
        h = h[: len(x) - n + 1] * np.uint64(0x100000001B3) + x[n - 1 :] + np.uint64(n)
        # a space only begins or ends an n-gram
        inner = np.ones(len(h), bool)
        for k in range(1, n - 1):
            inner &= ~space[k : k + len(h)]
        if n == 1:
            inner = ~space
        m = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)
        out.append(m[inner].astype(np.int32))
    return np.concatenate(out)


def _features(rows: DataFrame) -> DataFrame:
    """(lang, part, ids, weights, n) of (lang, part, text): each distinct bucket's share of the n n-grams of the text, and of a few of its words."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, ids, weights, sizes = [], [], [], []
        for i, t in enumerate(batch.column(2).to_pylist()):
            tokens = (t or "").split()
            few = " ".join(tokens[len(tokens) // 3 :][: 1 + len(tokens) % 7])  # short texts are learned from and calibrated on as well
            for x in (t or "", few):
                b = buckets_of(x)
                n = np.bincount(b, minlength=BUCKETS) if b is not None else np.zeros(1, np.int64)
                at = np.flatnonzero(n)
                rows.append(i)
                ids.append(at.astype(np.int32))
                weights.append((n[at] / max(1, n.sum())).astype(np.float32))
                sizes.append(int(n.sum()))
        kept = batch.take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float32())), pa.array(sizes, pa.int64())], ["lang", "part", "ids", "weights", "n"])

    return map_batches(rows, one, "lang string, part int, ids array<int>, weights array<float>, n long")


def train(
    docs: DataFrame, text: str = "text", lang: str = "lang", usable: Column | None = None,
    rows_per_language: int = ROWS_PER_LANGUAGE, reject_share: float = 0.001, epochs: int = 6, rate: float = 0.5, seed: int = 7,
) -> LanguageModel | None:
    """Fit on at most ``rows_per_language`` texts of each language, those with the least hashes; None without labelled letters.

    Rows count if ``usable`` holds, the label is not null and the text not null. Only the text is a feature, and only it is drawn by, so
    ids that repeat or are missing change nothing, and copies of a text in a language are one. All label
    values are learned; where they are more than ``ROWS`` allow, each has fewer texts, ``LEAST_ROWS`` at least.
    """
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), text), 1)
    pool = docs.where(usable if usable is not None else F.lit(True)).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    pool = pool.select(F.col(lang).alias("lang"), F.col(text).alias("text"), draw.alias("draw"))
    sizes = pool.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()
    if not sizes:
        return None
    rows_per_language = min(rows_per_language, max(LEAST_ROWS, ROWS // len(sizes)))
    # twice the texts asked for are below a language's bar, so that the least of them are nearly always all there
    bars = [(r["lang"], min((1 << 63) - 1, int((1 << 63) * (2 * rows_per_language + 100) / max(1, r["n"])))) for r in sizes]
    bars = docs.sparkSession.createDataFrame(bars, "_lang string, bar long")
    below = pool.join(F.broadcast(bars), F.col("lang") == F.col("_lang")).where("draw <= bar").groupBy("lang", "draw").agg(F.first("text").alias("text"))
    least = below.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("place") <= rows_per_language)
    sample = least.select("lang", F.pmod(F.xxhash64(F.lit(seed + 1), "draw"), F.lit(4)).cast("int").alias("part"), "text")
    data = _features(sample).where(F.size("ids") > 0).toArrow()
    if not data.num_rows:
        return None
    y_names = data.column("lang").to_pylist()
    languages = tuple(sorted(set(y_names)))
    place = {n: k for k, n in enumerate(languages)}
    y = np.array([place[n] for n in y_names])
    ids = [np.asarray(x.values) for x in data.column("ids")]
    weights = [np.asarray(x.values) for x in data.column("weights")]
    held = np.asarray(data.column("part")) == 0
    held &= np.isin(y, y[~held])  # languages with no other rows are learned from these
    rng = np.random.default_rng(seed)
    E = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    W = np.zeros((DIM, len(languages)), np.float32)
    fit = np.flatnonzero(~held)
    own = [xxhash.xxh64_intdigest(ids[i].tobytes() + weights[i].tobytes()) for i in fit]
    fit = fit[np.lexsort((y[fit], np.array(own, np.uint64)))]  # the same order in every run; rows equal in both are alike
    for epoch in range(epochs):
        step = rate * 20 * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            e = E[ids[i]]
            mean = weights[i] @ e
            z = mean @ W
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = W @ p
            W -= step * 0.05 * np.outer(mean, p)
            E[ids[i]] = e - step * weights[i][:, None] * back
    logits = E @ W
    check = np.flatnonzero(held) if held.any() else fit
    z = np.stack([weights[i] @ logits[ids[i]] for i in check])
    z -= z.max(1, keepdims=True)

    def loss(t: float) -> float:
        s = z / t
        return float(-(s[np.arange(len(check)), y[check]] - np.log(np.exp(s).sum(1))).mean())

    temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    p = np.exp(z / temperature)
    top, found = np.sort(p.max(1) / p.sum(1)), p.argmax(1)
    at = int(reject_share / 2 * len(check))  # half of the share for each level
    level = float(top[at]) if len(languages) > 1 else 0.0

    seen, rows = np.zeros((BUCKETS, len(languages))), np.maximum(np.bincount(y[fit], minlength=len(languages)), 1)
    for i in fit:
        seen[ids[i], y[i]] += weights[i]
    likely = np.log((1 - SMOOTHED) * seen / rows + SMOOTHED / BUCKETS).astype(np.float32)
    mean = np.array([weights[i] @ likely[ids[i], k] for i, k in zip(check, found)], np.float64)
    usual = np.array([np.median(mean[found == k]) if (found == k).any() else np.median(mean) for k in range(len(languages))])
    n = np.asarray(data.column("n"))[check]

    def spread(steady: float) -> float:  # Laplace, as a few labels contradict the text
        off = _unlike(mean, usual[found], n, steady)
        return float(np.log(np.abs(off).mean() + 1e-12) + np.log(1 / n + 1 / steady).mean() / 2)

    steady = float(min(np.geomspace(10, 100_000, 60), key=spread))
    unlike = np.sort(_unlike(mean, usual[found], n, steady))
    return LanguageModel(languages, logits.astype(np.float32), float(temperature), level, likely, usual, steady, float(unlike[at]))


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) and lang_pred, score, rejected for each whole text.

    lang_pred is a learned language, or ``und`` with score 0 and rejected for texts that are null or have no
    letter, and for all texts without a model. Others are rejected if their calibrated probability, the score, or the
    likelihood of their n-grams in that language is under the model's level. Columns of the same names as the new ones give way to them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        None
        if model is None
        else (model.languages, np.ascontiguousarray(model.logits.T), model.temperature, model.reject_below, np.ascontiguousarray(model.likely.T), model.usual, model.steady, model.unlike_below)
    )

    def scan(texts: list[bytes | None], _) -> list:
        pred, score, rejected = [], [], []
        for t in texts:
            b = buckets_of(t.decode("utf-8", "replace")) if t and shared.value else None
            if b is None:
                pred.append(UNKNOWN), score.append(0.0), rejected.append(True)
                continue
            languages, logits, temperature, level, likely, usual, steady, unlike_below = shared.value
            if len(b) < 20_000:
                z = logits[:, b].mean(1)
            else:
                z = (logits @ np.bincount(b, minlength=BUCKETS)) / len(b)
            z = z.astype(np.float64) / temperature
            p = np.exp(z - z.max())
            p /= p.sum()
            k = int(p.argmax())
            pred.append(languages[k]), score.append(float(p[k]))
            unlike = _unlike(likely[k][b].mean(dtype=np.float64), usual[k], len(b), steady)
            rejected.append(bool(p[k] < level or unlike < unlike_below - 1e-6))
        return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]

    return with_columns(docs, docs.columns if keep is None else keep, text, scan, "lang_pred string, score double, rejected boolean", ["lang_pred", "score", "rejected"])
