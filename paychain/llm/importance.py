"""Importance resampling towards a target text, by hashed runs of words.

Each text is a bag of hashed features. A bucket's gain is the logarithm of its share of the target over its share of
the corpus, in thousandths; a text's weight is the mean gain of its features. Documents are drawn without replacement by
Gumbel noise: the highest of weight plus noise, the noise from a digest of the key, so that reruns agree.

Higher-order functions turn a text into its array of buckets, and an aggregate over that array looks each gain up
in a literal array of all buckets' gains: texts are never exploded to be scored, and nothing of theirs is shuffled. Only
the counts of the buckets are, a row for each bucket and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paychain.llm.common import materialize

#: Longest run of words, buckets, words of a document that may be drawn, share drawn in hundredths, seed of the noise.
LONGEST, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _buckets(words: Column, longest: int, buckets: int) -> Column:
    """Array of the buckets of all runs of 1 to ``longest`` words."""

    def bucket(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % buckets).cast("int")

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(words, i, n), " ")))

    single = F.transform(words, bucket)
    return single if longest == 1 else F.concat(single, *(runs(n) for n in range(2, longest + 1)))


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into a bucket. Tasks count first, so a bucket that is a third of all is a row of each."""
    return docs.select(F.explode(_buckets(_words(text), longest, buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> list[int]:
    """Gain of each bucket: the only numbers that the driver sees, ``buckets`` of them."""
    corpus, wanted = bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets)
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(wanted.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = both.unionByName(docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    counts = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    all_s, all_t = (F.sum(c).over(W.partitionBy()).cast("double") for c in ("s", "t"))  # a row for each bucket
    gain = F.floor(1000 * F.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).cast("long")
    return [r["gain"] for r in counts.select("bucket", gain.alias("gain")).orderBy("bucket").collect()]


def weigh(docs: DataFrame, gain: list[int], key: str = "doc_id", text: str = "text", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score) of each row: mean gain, and that with noise."""
    table = F.expr(f"array({', '.join(f'{g}L' for g in gain)})")
    words = docs.select(F.col(key).alias("key"), _words(text).alias("words"))
    found = words.select("key", F.size("words").cast("long").alias("n_words"), _buckets(F.col("words"), longest, len(gain)).alias("buckets"))
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda sum_, b: sum_ + F.element_at(table, b + 1))
    found = found.select("key", "n_words", F.size("buckets").cast("long").alias("n_features"), total.alias("total"))
    many = F.greatest("n_features", F.lit(1).cast("long"))
    weight = F.call_function("div", F.col("total") - F.pmod("total", many), many)  # integers only, down
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0))).cast("long")
    return found.select("key", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise)


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of each row of ``docs``; rank is null where a row isn't drawn.

    Of the N rows with at least ``least_words`` words, floor(percent x N / 100) are drawn: highest score first, ties to the
    smaller key, null keys last, and rows equal in both in any order, each with a rank of its own. A null or empty text has no
    features and weight 0. A null key draws its noise as the empty text. Columns other than key and text are not read. An
    empty corpus gives no rows; an empty target makes frequent buckets lose and rare ones gain.

    The rank is global without a global sort: a score's count and those above it tell which scores are drawn
    whole; rows of scores down to the cut are range-sorted, numbered within a range, and ranges add up.
    """
    gain = gains(docs, target, text, target_text, longest, buckets)
    scored = materialize(weigh(docs, gain, key, text, longest, seed).withColumn("place", F.monotonically_increasing_id()))
    able = scored.where(F.col("n_words") >= least_words)
    # as many rows as there are scores; those are thousandths of bounded logarithms, tens of thousands in all
    by_score = able.groupBy("score").agg(F.count("*").alias("n"))
    above = F.sum("n").over(W.orderBy(F.desc("score"))) - F.col("n")
    cut = by_score.select("score", above.alias("above"), F.floor(F.sum("n").over(W.partitionBy()) * percent / 100).alias("most")).where("above < most").agg(F.min("score"), F.max("most")).first()
    names = ["key", "n_words", "n_features", "weight", "score"]
    none = F.lit(None).cast("long")
    if cut[0] is None:
        return scored.select(*names, none.alias("rank")).withColumnRenamed("key", key)
    hopeful = (F.col("n_words") >= least_words) & (F.col("score") >= cut[0])
    ranged = able.where(hopeful).repartitionByRange(F.desc("score"), F.col("key").asc_nulls_last(), "place").sortWithinPartitions(F.desc("score"), F.col("key").asc_nulls_last(), "place")
    numbered = materialize(ranged.select(*names, F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    sizes = numbered.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range
    before = sizes.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))
    place = F.col("before") + F.col("at") + 1
    first = numbered.join(F.broadcast(before), "range").select(*names, F.when(place <= cut[1], place).alias("rank"))
    return scored.where(~hopeful).select(*names, none.alias("rank")).unionByName(first).withColumnRenamed("key", key)


def oracle(buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> str:
    """The query over tables ``documents`` and ``benchmark`` for DuckDB, for single words."""
    return f"""
WITH tab AS (SELECT list(list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS tab FROM range(256) AS r(n)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
f AS (SELECT r, unnest(w) AS f FROM d), g AS (SELECT unnest(w) AS f FROM b),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM f UNION SELECT f FROM g)),
k AS (SELECT f, xor(4294967295, list_reduce(list_transform(range(0, len(x), 2), lambda i: ('0x' || substr(x, 1 + i, 2))::BIGINT), lambda c, v: xor(c >> 8, tab[1 + (xor(c, v) & 255)]), 4294967295)) % {buckets} AS k FROM h, tab),
s AS (SELECT k, count(*) AS s FROM f JOIN k USING (f) GROUP BY k), t AS (SELECT k, count(*) AS t FROM g JOIN k USING (f) GROUP BY k),
gain AS (SELECT range AS k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + {buckets})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM g) + {buckets})::DOUBLE)))::BIGINT AS gain
  FROM range({buckets}) LEFT JOIN s ON s.k = range LEFT JOIN t ON t.k = range),
total AS (SELECT r, sum(gain)::BIGINT AS total FROM f JOIN k USING (f) JOIN gain USING (k) GROUP BY r),
e AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce((total - ((total % len(w)) + len(w)) % len(w)) // len(w), 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise FROM d LEFT JOIN total USING (r)),
o AS (SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST, r) AS rank, count(*) OVER () AS n FROM e WHERE n_features >= {least_words})
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= floor(n * {percent} / 100) THEN rank END::BIGINT AS rank FROM e LEFT JOIN o USING (r)"""
