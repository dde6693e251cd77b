"""The queries opN_<name>, each an operator applied to its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paychain.llm import covertree, decontaminate, importance, langid, mixing, periodic, quality, secrets, simhash, suffixes, toxicity, urlfilter, warc
from paychain.llm.common import crc_remainder, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from rows with crc32(doc_id) mod 3 other than 1; the others are held out."""
    docs = table(spark, sf_dir, "documents")
    held = crc_remainder("doc_id", 3) == 1
    model = langid.train(docs, usable=~held)
    return langid.predict(docs, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index, payloads=False).select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"), texts=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, links at two or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from labels with crc32(doc_id) mod 5 other than 0; the others are held out."""
    docs = table(spark, sf_dir, "documents")
    held = crc_remainder("doc_id", 5) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=~held)
    found = toxicity.score(docs, model, keep=["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from labels with crc32(doc_id) mod 4 other than 2; the others are held out."""
    docs = table(spark, sf_dir, "documents")
    held = crc_remainder("doc_id", 4) == 2
    model = quality.train(docs, table(spark, sf_dir, "labels"), usable=~held)
    return quality.score(docs, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One in ten texts repeats its words from one place on; runs of six words and four periods."""
    docs = table(spark, sf_dir, "documents")
    h, words = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0))
    some = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when((h % 10 == 0) & F.col("text").isNotNull(), words).alias("w"))
    n, g = F.size("w"), F.col("g")
    some = some.select("*", F.when(n > 0, (g % n).cast("int")).alias("a")).select("*", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + g % 8)).cast("int")).alias("p"))
    a, p = F.col("a"), F.col("p")
    repeated = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", F.when(i < a, i).otherwise(a + (i - a) % p)))
    some = some.select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))
    found = periodic.find_runs(some, keep=["doc_id"])
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.col("strongest")
    exponent = F.call_function("div", 1000 * best["length"], best["period"])
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        exponent.alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_mix_sources, op3_decontaminate, op4_warc, op5_suffix_dedup, op6_url_filter, op7_simhash, op8_toxicity, op9_embedding_dedup, op10_secrets,
        op11_quality, op12_periodic_runs, op13_importance_resampling,
    )
}

#: Base-32 of 20 bits, five hexadecimal digits at a time.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)]), '')"

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = {
    "op3_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
hits AS (SELECT doc_id, n, p, item_id FROM dw JOIN iw USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op9_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(v, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON r.v = l.a),
c AS (SELECT v, min(root) AS component_id FROM r GROUP BY v), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON vec_id = c.v LEFT JOIN n ON vec_id = n.a""",
    "op4_warc": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p JOIN f USING (h)""",
    "op2_mix_sources": mixing.oracle(),
    "op5_suffix_dedup": suffixes.oracle(),
    "op6_url_filter": urlfilter.oracle(),
    "op12_periodic_runs": periodic.oracle(),
    "op13_importance_resampling": importance.oracle(),
}
