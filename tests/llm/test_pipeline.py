"""The pipeline against what each stage promises."""

import random
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    from paychain.llm.common import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    items = {r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    words = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+").findall
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = materialize(stage(spark, docs, SF))
        n = docs.count()
        assert 0 < n <= before
        before = n
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "SimHash near-dedup":
            assert docs.select("text").distinct().count() == n  # no copies
        if name == "benchmark decontamination":
            windows = {tuple(w[i : i + 10]) for t in items for w in [words(t.lower())] for i in range(len(w) - 9)}
            for r in docs.collect():
                w = words(r["text"].lower())
                assert not any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))
        if name == "secret scans":
            assert not [r for r in docs.collect() if re.search("AKIA[A-Z0-9]{14}|[0-9a-f]{16}", r["text"])]
    assert {"doc_id", "text", "taken"} <= set(docs.columns)


def test_documents_that_share_an_id_or_have_none_stay(spark):
    def text(seed):
        return " ".join(f"w{seed}x{k * k % 97}" for k in range(60))

    rows = [(1, text(1)), (1, text(2)), (1, text(1)), (None, text(3)), (None, text(4)), (2, text(4)), (None, text(5)), (3, text(6)), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    want = [(1, text(1)), (1, text(2)), (None, text(3)), (2, text(4)), (None, text(5)), (3, text(6)), (None, None)]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("block", [4096, 7])
def test_near_duplicates_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr("paychain.llm.simhash.BLOCK_SETS", block)
    r = random.Random(4)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    texts = [fresh(r.randint(1, 60)) for _ in range(20)]
    for shared, own in [(7, 3), (3, 1), (19, 6), (4, 1), (5, 1), (77, 23), (39, 11), (79, 21), (8, 2), (40, 10), (80, 20), (400, 100), (81, 19), (83, 17), (17, 3)]:
        for side in range(6):  # pairs that share so many shingles of shared + own: 0.7 to 0.85
            common = fresh(shared + 4)
            a = own * side // 10
            texts += [common + fresh(a), common + fresh(own - a)]
    base = fresh(104)
    texts += [base[: 94 + i % 11] + fresh(i % 7) for i in range(60)]  # many copies of one text
    texts += [["same"] * 400 + fresh(40), ["same"] * 400 + fresh(40)]  # alike in what they repeat only
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 10 * common >= 8 * len(sets[i] | sets[j]) and up[i] != up[j]:
                low, high = sorted((up[i], up[j]))
                up = [low if u == high else u for u in up]
    got = {x["doc_id"] for x in pipeline.near_duplicates(spark, docs, SF).collect()}
    assert got == set(up)


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, n_hit string, c0 string, _id long, taken string, component_id long"


def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows and ids, columns named like those of operators."""
    words = ["the", "house", "and", "river", "under", "morning", "light", "with", "stone", "garden", "walks", "slowly"]
    r = random.Random(3)
    prose = lambda n: " ".join(r.choice(words) + r.choice(["", "s", "ly", "ing"]) for _ in range(n))
    other = lambda n: " ".join(r.choice(["der", "hund", "läuft", "schön", "über", "brücke", "und", "nicht"]) for _ in range(n))
    rows = [(i, prose(60) if i % 2 else other(60), "en" if i % 2 else "de", None if i % 5 == 0 else f"s{i % 3}", 9) for i in range(60)]
    rows += [(60, None, None, None, None), (61, "", "en", "s1", 0), (62, " ", None, "s1", 1), (63, prose(30_000), "en", "s2", None), (None, prose(50), "en", "s0", 5), (None, prose(50), None, "s0", 5)]
    rows += [rows[1], rows[1], (1, prose(70), "en", "s1", 3), (64, rows[3][1], "en", "s1", 3)]
    return [(*x, 0.5, "mine", "own", "first", i % 4, "kept", 7) for i, x in enumerate(rows)]


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows_and_clashing_names(spark, stage):
    name, fn = pipeline.STAGES[stage]
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    got = fn(spark, docs, SF)
    found = [tuple(r) for r in got.collect()]
    if name.startswith("mixing"):
        assert sorted(got.columns) == sorted(docs.columns)
        assert {r["taken"] for r in got.select("taken").collect()} <= {k * len((x[1] or "").split()) for x in rows for k in (1, 2)}
        found = [(*x[:10], "kept", x[10]) for x in found]
        assert {x[0] for x in found} <= {x[0] for x in rows if (x[1] or "").strip()}
    else:
        assert got.columns == docs.columns
    assert all(x[5:9] == (0.5, "mine", "own", "first") and x[10:] == ("kept", 7) for x in found)
    texts = [x[1] for x in rows]
    if name == "language ID":
        assert not [x for x in found if not (x[1] or "").strip()] and all(x[2] for x in found)
        assert len(found) >= 0.9 * sum(bool((t or "").strip()) for t in texts)
    if name == "SimHash near-dedup":
        blank = lambda t: t if (t or "").strip() else None
        assert sorted(str(blank(x[1])) for x in found) == sorted(str(t) for t in {blank(t) for t in texts})
        assert [x[0] for x in found if x[1] == rows[3][1]] == [3]
    if name in ("benchmark decontamination", "secret scans"):
        assert sorted(str(x[:4]) for x in found) == sorted(str(x[:4]) for x in rows)  # nothing to cut here
        assert all(x[4] == (len(x[1]) if x[1] is not None else None) for x in found)


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_no_rows(spark, stage):
    docs = spark.createDataFrame([], ODD)
    assert pipeline.STAGES[stage][1](spark, docs, SF).count() == 0


def test_mix_takes_each_of_equal_rows_for_itself(spark):
    docs = spark.createDataFrame([(7, "a b c d e f g h i j", "en", s, 1) for s in "abc" for _ in range(40)] + [(None, None, None, "a", None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {}
    for r in pipeline.mix(spark, docs.repartition(3), SF).collect():
        got.setdefault(r["source"], []).append(r["taken"])
    want = {r["source"]: r["target"] for r in __import__("paychain.llm.mixing", fromlist=["mix"]).mix(docs).collect() if r["source"]}
    assert all(set(t) <= {10, 20} and abs(sum(t) - want[s]) <= 10 for s, t in got.items()) and len(got) == 3
