"""Quality by votes of the nearest labelled texts in a latent space.

A text's terms are its words, the shapes of its tokens (letters, capitals, digits and signs, runs of one kind
told once), pairs of neighbouring shapes and whether a token repeats the one before it, hashed into buckets. Terms are
weighed by the logarithm of their count and by how few texts have them, words and shapes to equal parts; a truncated singular value decomposition of a
bounded sample gives the latent space. The labelled texts' vectors, a bounded number, are broadcast; every
text is compared with all of them by exact cosine products of whole blocks, and the nearest vote with weights that grow with the similarity.
A logistic curve fitted to the votes that labelled texts get without their own turns votes into probabilities.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paychain.llm.common import small_batches, with_columns

#: Buckets of terms, dimensions of the latent space, neighbours that vote (more where they are equally near), and how sharply weights grow.
BUCKETS, DIM, NEIGHBOURS, SHARPNESS = 1 << 14, 64, 24, 12.0
#: Bounds of the labelled sample: texts that vote, and those of them that the latent space is fitted to.
SAMPLE_ROWS, FIT_ROWS = 4096, 2048
#: Texts that are compared with the labelled ones at a time.
BLOCK = 512

_SHAPE = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)
)  # letters beyond ASCII as small ones
_RUNS = re.compile(rb"(.)\1+", re.S)


@dataclass(frozen=True)
class QualityModel:
    weight: np.ndarray  # of each bucket, by how few texts have it
    space: np.ndarray  # BUCKETS x DIM, float32
    vectors: np.ndarray  # labelled texts x DIM, unit length or zero
    labels: np.ndarray  # 0 to 1: the share of label 1 among a text's labels
    prior: float
    slope: float
    offset: float


def _hash(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) & (BUCKETS - 1)


_AGAIN, _OTHER = _hash(b"again"), _hash(b"other")


class Tokens(dict):
    """Of a token, the bucket of its word and that of its shape in one number; tokens come again, so what was found is kept, up to a bound."""

    KEPT = 1 << 18

    def __init__(self) -> None:
        self.shapes: dict[bytes, int] = {}

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.KEPT:
            self.clear()
            self.shapes.clear()
        drawn = token.translate(_SHAPE)
        shape = self.shapes.get(drawn)
        if shape is None:
            shape = self.shapes[drawn] = _hash(b"s" + _RUNS.sub(rb"\1", drawn))
        self[token] = found = _hash(b"w" + token.lower()) * BUCKETS + shape
        return found


def terms(texts: list[bytes | None], tokens: Tokens | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count, is a shape) of the terms of all texts, by row and bucket; whole texts, none for null and blank ones."""
    tokens = Tokens() if tokens is None else tokens
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rows: list[int] = []
    for i, t in enumerate(texts):
        both = np.array(list(map(tokens.__getitem__, (t or b"").split())), np.int64)
        if len(both):
            shape = both & (BUCKETS - 1)
            again = np.where(both[1:] == both[:-1], _AGAIN, _OTHER)
            pairs = (shape[:-1] * 31 + shape[1:] * 17 + 5) & (BUCKETS - 1)
            found.append(np.unique(np.concatenate([both // BUCKETS, BUCKETS + shape, BUCKETS + pairs, BUCKETS + again]).astype(np.int32), return_counts=True))
            rows.append(i)
    if not rows:
        return (np.zeros(0, np.int64),) * 4
    at, n = (np.concatenate(x) for x in zip(*found))
    return np.repeat(rows, [len(x) for x, _ in found]), at & (BUCKETS - 1), n, at // BUCKETS


def _weighed(found: tuple[np.ndarray, ...], weight: np.ndarray, rows: int) -> np.ndarray:
    """Term weights: logarithm of the count times the bucket's weight; words and shapes of a text each of unit length."""
    row, bucket, n, shape = found
    w = (1 + np.log(n)) * weight[bucket]
    part = row * 2 + shape
    length = np.sqrt(np.bincount(part, w * w, 2 * rows))
    return w / np.maximum(length[part], 1e-12)


def embed(texts: list[bytes | None], weight: np.ndarray, space: np.ndarray, tokens: Tokens | None = None) -> np.ndarray:
    """Latent vectors of unit length; zero for texts without terms."""
    found = terms(texts, tokens)
    w = _weighed(found, weight, len(texts)).astype(np.float32)
    out = np.zeros((len(texts), space.shape[1]), np.float32)
    bounds = np.searchsorted(found[0], np.arange(len(texts) + 1))
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        if b > a:
            out[i] = w[a:b] @ space[found[1][a:b]]
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(length > 1e-9, out / np.maximum(length, 1e-9), 0)


def votes(vectors: np.ndarray, labelled: np.ndarray, labels: np.ndarray, prior: float, neighbours: int = NEIGHBOURS, own: np.ndarray | None = None) -> np.ndarray:
    """Weighted share of label 1 among the nearest labelled vectors, in log-odds, with one vote of the prior.

    All labelled vectors at the similarity of the last neighbour vote, so ties don't depend on an order. ``own``: of each
    vector, the labelled one that is its own and has no vote.
    """
    out = np.empty(len(vectors))
    for at in range(0, len(vectors), BLOCK):
        near = np.round(vectors[at : at + BLOCK] @ labelled.T, 5)
        if own is not None:
            near[np.arange(len(near)), own[at : at + BLOCK]] = -2
        k = min(neighbours, near.shape[1] - (own is not None))
        if k <= 0:
            out[at : at + BLOCK] = math.log(prior / (1 - prior))
            continue
        bar = np.partition(near, -k, axis=1)[:, [-k]]
        i, j = np.nonzero(near >= bar)
        w = np.exp(SHARPNESS * (near[i, j].astype(np.float64) - 1))
        one = np.bincount(i, w * labels[j], len(near)) + prior * 1e-3
        all_ = np.bincount(i, w, len(near)) + 1e-3
        out[at : at + BLOCK] = np.log((one + 1e-6) / (all_ - one + 1e-6))
    return out


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", usable: Column | None = None,
    sample_rows: int = SAMPLE_ROWS, fit_rows: int = FIT_ROWS, seed: int = 13,
) -> QualityModel | float:
    """Learn from at most ``sample_rows`` labelled texts, those with the least hashes of key and text; the latent space from ``fit_rows`` of them.

    Labels count if ``usable`` (on the labels' columns) holds and key and label are not null; a key with several labels
    has their mean. Texts that are equal are one, with the mean of their labels. Without labels of both kinds the share of label 1
    (a half without any) is returned instead of a model, and is every text's score.
    """
    small_batches(docs.sparkSession)
    told = (
        labels.where(usable if usable is not None else F.lit(True)).where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("_key")).agg(F.avg((F.col(label) > 0).cast("double")).alias("_label"))
    )
    printed = docs.select(F.col(key).alias("_key"), F.md5(F.col(text).cast("binary")).alias("_digest")).where(F.col("_digest").isNotNull())  # no texts in the shuffle
    chosen = printed.join(told, "_key").groupBy("_digest").agg(F.avg("_label").alias("_label"), F.min("_key").alias("_key"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(seed), "_key", "_digest"), "_digest").limit(sample_rows)  # a bounded heap in each task
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key").where(F.md5(F.col("_text").cast("binary")) == F.col("_digest"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode("utf-8", "replace") if t else None for t in batch.column(0).to_pylist()]
            row, bucket, n, shape = terms(texts)
            bounds = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
            packed = ((bucket << 1) | shape).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(bounds, pa.array(packed)), pa.ListArray.from_arrays(bounds, pa.array(n.astype(np.int32))), batch.column(1), batch.column(2)], ["terms", "n", "label", "digest"]
            )

    # one row of each text: copies with the same key would be rows of their own
    data = rows.select("_text", "_label", "_digest").dropDuplicates(["_digest"]).mapInArrow(count, "terms array<int>, n array<int>, label double, digest string").toArrow()
    if not data.num_rows:
        return 0.5
    by = np.argsort(np.array([xxhash.xxh64_intdigest(d) for d in data.column("digest").to_pylist()], np.uint64), kind="stable")
    y = np.asarray(data.column("label"))[by]
    if not 0 < y.mean() < 1:
        return float(y.mean())
    packed, counts = ([np.asarray(x.values) for x in data.column(c)] for c in ("terms", "n"))
    packed, counts = [packed[i] for i in by], [counts[i] for i in by]
    seen = np.bincount(np.concatenate([np.unique(p >> 1) for p in packed]).astype(np.int64), minlength=BUCKETS)
    weight = np.log((1 + len(y)) / (1 + seen)) + 0.1
    sizes = [len(p) for p in packed]
    row = np.repeat(np.arange(len(y)), sizes)
    flat, n = np.concatenate(packed).astype(np.int64), np.concatenate(counts)
    w = _weighed((row, flat >> 1, n, flat & 1), weight, len(y)).astype(np.float32)
    bucket, bounds = flat >> 1, np.cumsum([0, *sizes])
    fit = min(fit_rows, len(y))
    dense = np.zeros((fit, BUCKETS), np.float32)
    np.add.at(dense, (row[: bounds[fit]], bucket[: bounds[fit]]), w[: bounds[fit]])
    space = _right_vectors(dense, DIM, seed)
    vectors = np.zeros((len(y), space.shape[1]), np.float32)
    for i in range(len(y)):
        vectors[i] = w[bounds[i] : bounds[i + 1]] @ space[bucket[bounds[i] : bounds[i + 1]]]
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.where(length > 1e-9, vectors / np.maximum(length, 1e-9), 0).astype(np.float32)
    prior = float(y.mean())
    slope, offset = _logistic(votes(vectors, vectors, y, prior, own=np.arange(len(y))), y)
    return QualityModel(weight, space, vectors, y, prior, slope, offset)


def _right_vectors(a: np.ndarray, dim: int, seed: int, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors of ``a``, by subspace iteration from a random start."""
    dim = min(dim, *a.shape)
    q = np.random.default_rng(seed).normal(size=(a.shape[1], min(dim + 8, *a.shape))).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(a.T @ np.linalg.qr(a @ q)[0])[0]
    _, value, turn = np.linalg.svd(a @ q, full_matrices=False)
    use = np.flatnonzero(value[:dim] > 1e-4 * value[0])
    return np.ascontiguousarray(q @ turn[use].T)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a small ridge."""
    X, w = np.stack([x, np.ones_like(x)], 1), np.array([0.1, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        step = np.linalg.solve(X.T @ (X * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), X.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def score(docs: DataFrame, model: QualityModel | float, text: str = "text", keep: list[str] | None = None, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``keep`` columns (all by default) and ``score`` (0 to 1) of each whole text; a column of that name gives way.

    Null, empty and blank texts have no terms: no labelled text is near, all vote alike, and the score is that of the common share.
    Repeated rows score alike. No rows give no rows.
    """
    told = model if isinstance(model, float) else (model.weight, model.space, model.vectors, model.labels, model.prior, model.slope, model.offset)
    shared = docs.sparkSession.sparkContext.broadcast(told)  # BUCKETS x DIM and SAMPLE_ROWS x DIM numbers at most

    tokens = Tokens()  # each task has its own

    def scan(texts: list[bytes | None], _) -> list:
        if isinstance(shared.value, float):
            return [pa.array([shared.value] * len(texts), pa.float64())]
        weight, space, vectors, labels, prior, slope, offset = shared.value
        x = votes(embed(texts, weight, space, tokens), vectors, labels, prior, neighbours)
        return [pa.array(1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30))), pa.float64())]

    return with_columns(docs, docs.columns if keep is None else keep, text, scan, "score double", ["score"])
