"""From raw documents to packed sequences: quality, language, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run``
writes each result into the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import language_id, near_duplicates, packing, quality_classifier
from quire.llm.common import small_batches, stored
from quire.llm.vocabulary import read_json

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the compression classifier, fitted on the labels, predicts good. Blank texts pass with the prior."""
    small_batches(spark)
    model = quality_classifier.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    return quality_classifier.score_quality(docs, model, COLUMNS).filter("predicted = 1").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the languages learned from the labelled rows; texts without letters, or less like theirs than labelled texts of that length, go."""
    small_batches(spark)
    model = language_id.fit_languages(docs, ["doc_id"], "lang")
    return language_id.known_language(docs, model, language_id.fit_cutoffs(docs, model, "lang"), COLUMNS).select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, that of the smallest doc_id; equal rows count as one."""
    small_batches(spark)
    tagged = docs.withColumn("tag", F.xxhash64("text", "lang", "source", "n_chars"))
    who = F.struct("doc_id", "tag").alias("who")
    kept = near_duplicates.near_duplicates(tagged.select(who, "text"), "who").filter("kept").select(F.col("who.doc_id").alias("kept_id"), F.col("who.tag").alias("kept_tag")).distinct()
    staying = tagged.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("tag") == F.col("kept_tag")), "left_semi")
    return staying.dropDuplicates(["doc_id", "tag"]).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1,024 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs, read_json(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN), "doc_id")


STAGES = [("quality_classifier", quality), ("language_id", language), ("near_duplicates", deduplicate), ("packing", pack)]

#: Learned models and signatures have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
