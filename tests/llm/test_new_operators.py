"""Quality votes, periodic runs and importance resampling against brute force, with nulls, empty and repeated rows, ties and empty tables."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from paychain.llm import importance, periodic, quality, queries

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_runs(words, least, periods):
    """Every period by comparing all words so far apart."""
    best, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                best.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, length, q) for (s, length), q in best.items() if length >= max(least, periods * q))


def some_words(seed):
    r = random.Random(seed)
    n, k = r.randint(0, 60), r.randint(1, 4)
    words = [r.choice("abcd"[:k]) for _ in range(n)]
    if n > 4 and r.random() < 0.6:
        a, p = r.randrange(n), r.randint(1, 6)
        words = [words[a + (i - a) % p] if i >= a and a + (i - a) % p < n else words[i] for i in range(n)]
    return words


@pytest.mark.parametrize("least, periods", [(6, 4), (2, 2), (4, 3)])
def test_runs_of_small_texts(least, periods):
    texts = [some_words(s) for s in range(400)]
    for words, (n, runs, best, kept) in zip(texts, periodic._collapse([" ".join(w).encode() for w in texts], least, periods)):
        told = sorted((r["start"], r["length"], r["period"]) for r in runs)
        assert n == len(words) and told == brute_runs(words, least, periods)
        gone = {i for s, length, q in told for i in range(s + q, s + length)}
        assert kept.decode() == " ".join(w for i, w in enumerate(words) if i not in gone)
        if told:
            top = max(told, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
            assert (best["start"], best["length"], best["period"]) == top
        else:
            assert best is None


def test_runs_of_odd_rows(spark):
    long = " ".join(["ein", "zwei", "drei"] * 40_000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "x " * 6), (4, "x " * 6), (None, "ä ö " * 4), (5, "x x " * 7), (6, long), (7, "a b a b a b a")]
    docs = spark.createDataFrame([(*r, "own", 1.0) for r in rows], "doc_id long, text string, runs string, strongest double")
    got = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.find_runs(docs).collect())
    assert got == [
        (0, 8, [(0, 8, 2)], "ä ö"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 6, [(0, 6, 1)], "x"), (4, 6, [(0, 6, 1)], "x"),
        (5, 7, [(0, 7, 1)], "x x"), (6, 120_000, [(0, 120_000, 3)], "ein zwei drei"), (7, 7, [], "a b a b a b a"),
    ]
    assert periodic.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(docs, least_periods=1)


def brute_resample(docs, target, longest, buckets, least, percent, seed):
    upper = str.maketrans(importance.UPPER, importance.LOWER)

    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(upper))

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, x in docs:
        np.add.at(s, features(x), 1)
    for x in target:
        np.add.at(t, features(x), 1)
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s.sum() + buckets) / ((s[k] + 1) * (t.sum() + buckets)))) for k in range(buckets)]
    out = []
    for key, x in docs:
        f = features(x)
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = {}
    for i, r in enumerate(able[: percent * len(able) // 100]):
        ranks.setdefault(tuple(r[:4]), []).append(i + 1)
    return sorted(repr([*r[:4], ranks[tuple(r[:4])].pop(0) if r[4] and ranks.get(tuple(r[:4])) else None]) for r in out)


@pytest.mark.parametrize("longest, percent", [(1, 10), (3, 60), (2, 100)])
def test_resampling(spark, longest, percent):
    r = random.Random(longest)
    vocabulary = ["".join(r.choice("abcäß") for _ in range(r.randint(1, 4))) for _ in range(60)]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for i in range(120)]
    docs += [(None, None), (200, ""), (201, " ."), (None, docs[3][1]), (4, docs[4][1]), (4, docs[4][1]), (300, "Aİb " * 4000)] + [(77, "one two " * 15)] * 40
    target = [" ".join(r.choice(vocabulary[:20]) for _ in range(30)) for _ in range(9)] + [None, ""]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, rank string, weight string").repartition(5)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    found = importance.resample(df, items, longest=longest, buckets=97, percent=percent)
    got = sorted(repr([x[c] for c in ("doc_id", "n_features", "weight", "score", "rank")]) for x in found.collect())
    assert got == brute_resample(docs, target, longest, 97, 20, percent, 2024)


def test_resampling_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, docs).count() == 0
    rows = {r["doc_id"]: r for r in importance.resample(docs, none).collect()}
    assert all(r["rank"] is None for r in rows.values()) and rows[2]["weight"] == 0 and rows[1]["n_features"] == 2
    assert sum(r["rank"] is not None for r in importance.resample(docs, none, least_words=0, percent=100).collect()) == 2


def test_only_counts_are_shuffled(spark):
    """Scoring has no exchange, no explode and no Python."""
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = importance.weigh(df, [0] * importance.BUCKETS)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Generate|Python|MapIn", plan)


def test_votes_are_exact(spark):
    """Votes of the nearest in blocks against a loop over all labelled vectors."""
    g = np.random.default_rng(3)
    labelled, y = g.normal(size=(90, 8)).astype(np.float32), g.integers(0, 2, 90).astype(float)
    labelled /= np.linalg.norm(labelled, axis=1, keepdims=True)
    labelled[10:14] = labelled[10]  # ties
    x = np.concatenate([labelled[5:12], g.normal(size=(700, 8)).astype(np.float32), np.zeros((1, 8), np.float32)])
    got = quality.votes(x, labelled, y, 0.6, 7)
    for i in (0, 3, 6, 100, 650, 706, len(x) - 1):
        sims = [round(float(np.dot(x[i], v)), 5) for v in labelled]
        bar = sorted(sims)[-7]
        w = [math.exp(quality.SHARPNESS * (s - 1)) if s >= bar - 2e-5 else 0 for s in sims]
        one, all_ = sum(a * b for a, b in zip(w, y)) + 0.6e-3, sum(w) + 1e-3
        assert math.isclose(got[i], math.log((one + 1e-6) / (all_ - one + 1e-6)), rel_tol=0.2, abs_tol=0.05)


def quality_rows(n):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(5, 80))]
        good = i % 4 > 0
        text = " ".join(w).capitalize() + "." if good else r.choice([" | ".join(w), " ".join(x + "###" for x in w), " ".join(x for x in w for _ in "ab")])
        docs.append((i, text))
        labels.append((i, int(good), None))
    return docs, labels


def test_quality_of_held_out_and_odd_rows(spark):
    docs, labels = quality_rows(600)
    odd = [(1000, None), (1001, ""), (1002, " \n"), (None, docs[1][1]), (1, docs[1][1]), (1, docs[1][1]), (1003, "word. " * 30_000)]
    d = spark.createDataFrame([(*x, "a", 0.5) for x in docs + odd], "doc_id long, text string, score string, quality double")
    lab = spark.createDataFrame([*labels, (None, 1, 0), (1000, 1, 0), (5, None, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(d, lab, usable=F.col("doc_id") % 3 > 0)
    assert len(model.labels) <= quality.SAMPLE_ROWS
    got = {}
    for r in quality.score(d, model, keep=["doc_id"]).collect():
        assert 0 <= r["score"] <= 1
        got.setdefault(r["doc_id"], set()).add(round(r["score"], 6))
    assert len(got[1]) == 1 and got[None] == got[1] and got[1000] == got[1001] == got[1002]  # equal texts score alike
    held = [(min(got[i]), y) for i, y, _ in labels if i % 3 == 0]
    assert sum((s >= 0.7) == (y == 1) for s, y in held) / len(held) > 0.97
    assert quality.score(d.limit(0), model).count() == 0
    small = quality.train(d, lab, sample_rows=50, fit_rows=20)
    assert len(small.labels) <= 50


def test_quality_without_both_kinds(spark):
    docs, labels = quality_rows(20)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for rows, told in (([], 0.5), ([(i, 1) for i in range(9)], 1.0), ([(None, 1), (77, 0)], 0.5)):
        model = quality.train(d, spark.createDataFrame(rows, "doc_id long, quality int"))
        assert model == told and {r["score"] for r in quality.score(d, model).collect()} == {told}
    assert quality.train(d.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) == 0.5


def test_queries_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("op12_periodic_runs", "op13_importance_resampling"):
        df, told = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLE_SQL[name])
        names = [x[0] for x in told.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(repr([r[n] for n in names]) for r in df.collect()) == sorted(repr(list(r)) for r in told.fetchall())


def test_quality_query(spark):
    found = queries.QUERIES["op11_quality"](spark, SF)
    assert dict(found.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL")
    rows = found.join(labels, "doc_id").where("held_out").select("quality", "predicted").collect()
    assert found.count() == 1000 and sum(r["quality"] == r["predicted"] for r in rows) / len(rows) > 0.93
