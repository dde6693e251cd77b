"""The corpus pipeline: five stages from raw documents to a mixed training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. ``run`` writes each stage's result as a table in the shared folder and reads it for
the next, so that a lost executor costs a task of one stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paychain.llm import decontaminate, langid, mixing, secrets, simhash
from paychain.llm.common import cut_spans, discard, materialize, table

#: Of a document's words, the share in benchmark passages over which it goes as a whole.
MOST_CONTAMINATED = 0.5


class Named:
    """``docs`` under column names of our own, so that none of theirs clashes with a column that an operator adds."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.frame = docs.toDF(*(f"c{i}" for i in range(len(self.names))))

    def of(self, name: str) -> str:
        return f"c{self.names.index(name)}"

    def back(self, df: DataFrame, *more: Column, **changed: Column) -> DataFrame:
        """The columns of ``docs`` under their names, those in ``changed`` with new values, and ``more``."""
        return df.select(*(changed.get(n, F.col(f"c{i}")).alias(n) for i, n in enumerate(self.names)), *more)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: those without a letter (null and empty texts too) and those of no learned language.

    The model learns from the labelled rows of ``docs``; where there are none, nothing is learned and all go. A missing
    lang is filled in. Repeated rows, repeated ids and very long texts are judged each, by the whole text. Extra columns
    stay as they are, whatever their names. No rows give no rows.
    """
    own = Named(docs)
    text, lang = own.of("text"), own.of("lang")
    model = langid.train(own.frame, text=text, lang=lang)
    found = langid.predict(own.frame, model, text=text).where("NOT rejected")
    return own.back(found, lang=F.coalesce(lang, "lang_pred"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a similarity of 0.8 or more in five-word shingles, the document with the smallest id stays.

    Where ids repeat or several are missing, each row is a document of its own: rows without an id come last, rows that
    share one are in the order of their text's digest, and only rows equal in all columns by their place. Null, empty and
    blank texts are copies of each other. Whole texts count, however long. Extra columns stay as they are, whatever their
    names. No rows give no rows.
    """
    own = Named(docs)
    rows, key, text = own.frame, own.of("doc_id"), own.of("text")
    if not rows.groupBy(key).count().where("count > 1").isEmpty():
        plain = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
        order = F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("id"), F.md5(F.col(text).cast("binary")).alias("digest"), F.xxhash64(*plain).alias("rest"), F.monotonically_increasing_id().alias("place"))
        rows, key = materialize(rows.withColumn("own", order)), "own"
    found = simhash.near_duplicates(rows, key, text, size=5, similarity=0.8)
    kept = found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("kept"))
    return own.back(rows.join(kept, F.col(key).eqNullSafe(F.col("kept")), "left_semi"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts; documents that are mostly such passages go.

    Null and empty texts hold no passage and stay; repeated rows and ids and very long texts are scanned each, as wholes.
    n_chars follows the text. Extra columns stay as they are, whatever their names. No rows give no rows, an empty
    benchmark leaves all as it is.
    """
    own = Named(docs)
    text = own.of("text")
    found = decontaminate.find_contamination(own.frame, table(spark, sf_dir, "benchmark"), text=text)
    found = found.where(F.col("n_hit") <= MOST_CONTAMINATED * F.col("n_words"))
    return own.back(cut_spans(found, text, "spans", "\n"), **_chars(own))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and what belongs to them are replaced by a mark; all documents stay.

    Null and empty texts hold none; repeated rows and ids and very long texts are scanned each, as wholes. n_chars follows
    the text. Extra columns stay as they are, whatever their names. No rows give no rows.
    """
    own = Named(docs)
    text = own.of("text")
    return own.back(cut_spans(secrets.find_secrets(own.frame, text=text), text, "spans", "[removed]"), **_chars(own))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: the documents and, as ``taken``, the words taken of each, repeats counted.

    Texts without words (null and empty ones too) are never taken; a null source is a source like any other. Rows equal in id,
    source and text are taken each for itself: where the budget ends among them, some are taken once more than the others. Extra columns stay as they are,
    whatever their names, but for one named ``taken``, which gives way. No rows give no rows.
    """
    own = Named(docs.drop("taken"))
    key, text = own.of("doc_id"), own.of("text")
    source = own.of("source")
    taken = mixing.mix(own.frame, key, text, source).groupBy(F.col(key).alias("id"), F.col(source).alias("from"), "print").agg(F.min("taken").alias("least"), F.max("taken").alias("taken"), F.sum("taken").alias("all"), F.count("*").alias("n")).where("taken > 0")
    same = F.col(key).eqNullSafe(F.col("id")) & F.col(source).eqNullSafe(F.col("from")) & (F.xxhash64(text) == F.col("print"))
    rows = own.frame.join(taken, same)
    # the budget ends within one group of equal rows of a source at most
    place = F.row_number().over(Window.partitionBy("id", "from", "print").orderBy("place"))
    more = (F.col("all") - F.col("n") * F.col("least")) / (F.col("taken") - F.col("least"))
    some = rows.where("least < taken").withColumn("place", F.monotonically_increasing_id()).withColumn("place", place)
    some = some.select(*own.frame.columns, F.when(F.col("place") <= more, F.col("taken")).otherwise(F.col("least")).alias("taken")).where("taken > 0")
    return own.back(rows.where("least = taken").select(*own.frame.columns, "taken").unionByName(some), F.col("taken"))


def _chars(own: Named) -> dict[str, Column]:
    """Lengths follow the text; a text that was null keeps what it had."""
    return {"n_chars": F.coalesce(F.length(own.of("text")).cast("long"), F.col(own.of("n_chars")))}


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix),
]

#: SQL can't express the trained and iterative stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        if place:
            discard(before)  # the table of the stage before; the input stays
    return docs
