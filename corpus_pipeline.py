"""A training-data pipeline over ``documents``: five stages, each one operator.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before
kept. The first four return the columns of ``documents``; the last returns tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm import bpe, decontaminate, lang_id, line_dedup, near_dedup
from lexquarry.llm.common import discard, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: The least pooled probability of the predicted language. Of the held-out documents of the test tables, which are all
#: in learned languages, the lowest has 0.39 (a text of seven letters).
LEAST_SCORE = 0.3


def with_key(docs: DataFrame) -> DataFrame:
    """The rows, written with a key of their own: ids may be null or repeat."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("row_key"), *COLUMNS), "rows")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter, no text) go, as do those whose language is less sure than LEAST_SCORE; lang becomes the predicted one."""
    found = lang_id.predict(docs, lang_id.fit(docs), carry=("source", "n_chars"))
    return found.where((F.col("lang_pred") != lang_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines found in ten documents or more the first occurrence stays; documents of which nothing but white space is left go, too."""
    carry = ("lang", "source")
    texts = line_dedup.kept_texts(docs, min_docs=10, keep_first=True, carry=carry)
    left = texts.where(F.translate("text", " \t\n\x0b\x0c\r", "") != "")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class stays, one with the smallest id (null ids come last, rows that share an id count one by one)."""
    rows = with_key(docs)
    classes = near_dedup.near_duplicates(rows, id_col="row_key", words=5, percent=80).select("row_key", "component_id")
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key"))
    kept = rows.select("row_key", "doc_id").join(classes, "row_key").groupBy("component_id").agg(F.min_by("row_key", first).alias("row_key"))
    return rows.join(kept, "row_key", "left_semi").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = with_key(docs)
    leaks = decontaminate.leaks(rows, benchmark, id_col="row_key").select("row_key").distinct()
    return rows.join(leaks, "row_key", "left_anti").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of ids and decoded bytes."""
    return bpe.encode_digest(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", tokenize),
]

#: A trained network and signatures can't be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{i + 1}")
        discard(before)
    return docs
