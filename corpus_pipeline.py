"""Corpus pipeline: quality filter, near-duplicate removal, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but
the last return the columns of documents, whatever their names. run() writes each stage's result as Parquet to the
shared folder and reads it back, so a lost executor costs no more than the stage that runs.

Nulls and edge cases: a null or empty text is judged by its site, links with nothing, holds no secret and
is one end token; a null id stays through all stages; a null source or lang is a site and an owner of its own;
an empty table gives an empty result. What each stage does with repeated rows stands there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import ngram_join, quality, secrets
from pagelake.llm.common import Scratch, bounded, free_name, quoted, table
from pagelake.llm.queries import pack_documents

#: Up to so many ids are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 500_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; repeated rows are judged each."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates; documents without an id or words stay.

    Rows of one id and different texts are different documents: the text with the smallest hash has the id, each
    other one a large number of its own. Of rows with equal id and text the smallest stays.
    """
    found = Scratch(spark, "dedup")
    names = docs.columns
    key, least = free_name("key", names), free_name("least", names)
    text_hash = F.xxhash64("text")
    rows = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(text_hash).alias("h"))
    repeated = found.save(rows.filter("n > 1").select("doc_id", F.col("h").alias(least)), "repeated")
    keyed = docs.join(bounded(repeated, BROADCAST_ROWS), "doc_id", "left")
    own = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("doc_id", text_hash), 2)
    keyed = keyed.withColumn(key, F.when(F.col(least) != text_hash, own).otherwise(F.col("doc_id").cast("long")))
    groups = found.save(ngram_join.near_duplicates(keyed, id_col=key).select("doc_id", "component_id"), "groups")
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    stays = keyed.join(bounded(gone, BROADCAST_ROWS), key, "left_anti")
    whole = F.struct(*map(quoted, names))
    once = stays.filter(F.col(least).isNotNull()).groupBy(key).agg(F.min(whole).alias("row")).select(*(F.col(f"row.{quoted(c)}").alias(c) for c in names))
    return stays.filter(F.col(least).isNull()).select(*map(quoted, names)).unionByName(once)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets that look live are masked and n_chars follows the text. Repeated rows are one owner's."""
    clean = secrets.redact(docs, repo=F.concat_ws("/", "source", "lang"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*map(quoted, docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; repeated rows are packed each."""
    return pack_documents(docs)


STAGES = [("quality_classifier", keep_quality), ("ngram_jaccard_join", drop_near_duplicates), ("secret_scan", redact_secrets), ("packing", pack)]

#: Classifier and packing have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
