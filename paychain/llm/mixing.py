"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in shuffled order, the whole queue as often as a document may be
taken. A queued copy has a virtual finish time: the source's words up to and with it, divided by
the source's weight. All copies are range-sorted by finish time and the sequence is cut where the
total budget is used up. A source that has run out leaves the rest to the others in proportion to
their weights, so the cut is also where each source has received its target.

Running totals are summed in two levels, slots of a few thousand rows within a source, so a source
that holds a third of all rows is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paychain.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, COPIES, SLOT_ROWS, SEED = (3, 1, 2), 1.5, 2, 4096, 5
#: Rows that a range of finish times has, about, where Spark's own number of ranges would make them larger.
RANGE_ROWS = 1 << 23
#: Bits of the draw that shuffles a source; slots follow its leading ones.
DRAW_BITS = 60


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """(source, rank, weight, rows, source_size, target): one row for each source, ranked by code point, null last.

    Targets share ``share`` of all sizes by weight; none exceeds ``copies`` times its source's size, and what is
    over goes to the others by weight. With r = most / weight in rising order, a source is full while r is no
    more than (budget - what the full ones take) / (weights of the rest); that level is what the others get.
    """
    ranks = W.orderBy(F.col("source").asc_nulls_last())
    level = W.orderBy("r", "rank")
    before = level.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    lists = F.array(*(F.lit(float(w)) for w in weights))
    return (
        sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(ranks))
        .withColumn("weight", F.get(lists, (F.col("rank") - 1) % len(weights)))
        .withColumn("r", copies * F.col("source_size") / F.col("weight"))
        .withColumn("rest", share * F.sum("source_size").over(whole) - copies * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("level", F.col("rest") / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("level", F.max(F.when(F.col("r") > F.col("level"), F.col("level"))).over(whole))
        .select("source", "rank", "weight", "rows", "source_size", F.least(copies * F.col("source_size").cast("double"), F.col("level") * F.col("weight")).alias("target"))
    )


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES, seed: int = SEED,
) -> DataFrame:
    """(key, source, size, source_size, target, taken, print) for each row of ``docs``.

    size counts the words of the whole text, null has none. taken is what the mix takes of the row, repeats
    counted: 0, size or up to ``copies`` times size. print is a hash of the text, by which, with the key, rows can
    be found again. The shuffle depends on key and text alone, so reruns agree; of rows that are equal in
    both each is taken for itself, so that copies don't come all or none. A null source is a source like any other. Other columns are not read. No rows give no rows; the result is
    within one document of each target, as whole documents are taken.
    """
    drawn_by = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("key").cast("string"), F.lit("")), F.coalesce("digest", F.lit("")))
    draw = F.conv(F.substring(F.md5(drawn_by.cast("binary")), 1, DRAW_BITS // 4), 16, 10).cast("long")
    sized = materialize(
        docs.select(
            F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("print"), F.md5(F.col(text).cast("binary")).alias("digest")
        ).withColumn("draw", draw).drop("digest")
    )
    targets = materialize(source_targets(sized, weights, share, copies))
    slots = F.ceil(F.col("rows") / SLOT_ROWS)
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select(
        "key", targets["source"], "size", "print", "draw", "rank", "weight", "source_size", "target", (F.shiftright("draw", DRAW_BITS - 32) * slots / (1 << 32)).cast("long").alias("slot")
    )
    order = ["draw", "key", "size"]
    slot_sums = rows.groupBy("rank", "slot").agg(F.sum("size").alias("slot_size"))
    before = W.partitionBy("rank").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    slot_sums = slot_sums.select("rank", "slot", F.coalesce(F.sum("slot_size").over(before), F.lit(0)).alias("before"))
    within = W.partitionBy("rank", "slot").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)  # equal rows end one after the other
    queued = materialize(rows.withColumn("done", F.sum("size").over(within)).join(slot_sums, ["rank", "slot"]).withColumn("done", F.col("done") + F.col("before")).drop("before", "slot"))

    def place(copy: int) -> list[Column]:
        return [((copy * F.col("source_size") + F.col("done")) / F.col("weight")).alias("finish"), "rank", F.lit(copy).alias("copy"), *order]

    entries = queued.select(F.explode(F.array(*(F.struct(*place(c)) for c in range(copies)))).alias("e")).select("e.*").where("size > 0")
    names = ["finish", "rank", "copy", *order]
    ranges = -(-copies * (targets.agg(F.sum("rows")).first()[0] or 0) // RANGE_ROWS)
    more = [ranges] if ranges > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    ranged = materialize(entries.repartitionByRange(*more, *names).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.sum("size").alias("n"))
    upto = W.orderBy("part")
    parts = parts.withColumn("upto", F.sum("n").over(upto)).withColumn("budget", F.floor(min(share / copies, 1.0) * F.sum("n").over(W.partitionBy())))
    at = parts.where("upto >= budget").orderBy("part").limit(1).first()  # the part in which the budget ends
    last, backwards = None, [F.desc(n) for n in names]
    if at is not None:
        here = ranged.where(F.col("part") == at["part"]).withColumn("running", F.sum("size").over(W.orderBy(*names)) + (at["upto"] - at["n"]))
        last = here.where(F.col("running") <= at["budget"]).orderBy(*backwards).first() or ranged.where(F.col("part") < at["part"]).orderBy(*backwards).first()
    taken = F.lit(0)
    if last is not None:
        end = F.struct(*(F.lit(last[n]).cast(ranged.schema[n].dataType).alias(n) for n in names))
        taken = sum((F.when(F.struct(*place(c)) <= end, F.col("size")).otherwise(0) for c in range(copies)), F.lit(0))
    return queued.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), "print")


def oracle(weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES, seed: int = SEED) -> str:
    """The query over table ``documents`` for DuckDB."""
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')), 1, {DRAW_BITS // 4}))::BIGINT AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, ({list(map(float, weights))}::DOUBLE[])[1 + (rank - 1) % {len(weights)}] AS weight FROM s),
v AS (SELECT *, {copies} * source_size / weight AS r FROM w),
b AS (SELECT *, {share}::DOUBLE * sum(source_size) OVER () - {copies} * coalesce(sum(source_size) OVER before, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS others
  FROM v WINDOW before AS (ORDER BY r, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, rank, weight, source_size, least({copies}::DOUBLE * source_size, weight * max(CASE WHEN r > rest / others THEN rest / others END) OVER ()) AS target FROM b),
q AS (SELECT d.r, doc_id, d.source, size, draw, rank, weight, source_size, target, sum(size) OVER (PARTITION BY rank ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS done FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT r, size, sum(size) OVER (ORDER BY (copy * source_size + done) / weight, rank, copy, draw, doc_id, size) AS running FROM q, range({copies}) AS c(copy) WHERE size > 0),
k AS (SELECT r, sum(size) AS taken FROM e WHERE running <= (SELECT floor({min(share / copies, 1.0)}::DOUBLE * {copies} * sum(size)) FROM d) GROUP BY r)
SELECT doc_id, source, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN k USING (r)"""
