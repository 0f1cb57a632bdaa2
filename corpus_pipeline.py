"""A training corpus from the documents table: quality rules, line
deduplication, near-duplicate removal, redaction, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brook.llm import common, lines, packing, pii, quality, simhash


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    """``out`` with the columns of ``docs`` and the length of the new text."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and host verdicts keep."""
    return quality.drop_rejected(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without line blocks that an earlier one holds."""
    return _like(docs, lines.drop_common_lines(docs, whole=True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 4-word-shingle fingerprints within 4 bits."""
    return simhash.drop_near_duplicates(docs, words_per_shingle=4, radius=4)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return _like(docs, pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=4096, end_id=2)
    return got.select(F.col("doc").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("simhash near-dedup", near_dedup),
          ("pii", redaction), ("packing", packed)]

# Fingerprints, boosted trees and token ids are beyond SQL; tests compare the
# stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.scratch(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"), spark)
    return STAGES[-1][1](spark, docs, sf_dir)
