"""A corpus pipeline of five of the training-data operators; each stage works on what the one before kept.

Every stage reads whole texts of all its rows. Columns besides doc_id, text, lang and source go along untouched, whatever their
names (n_chars follows the text); an empty table stays empty. What a stage does with nulls, ties and repeated rows is said
at each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.llm import decontaminate, near_dedup, packing, pii, quality_rules
from cellspan.llm.common import small_batches, stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have no words and go. Null languages and sources are groups of their own; repeated rows are judged
    alike; where documents are too few for an estimate the base rules alone decide.
    """
    small_batches(spark)
    return quality_rules.keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the least doc_id.

    Null texts and texts without words are one class; of repeated rows one stays; a null doc_id stays only where its class
    has no other; long texts are compared whole.
    """
    small_batches(spark)
    return near_dedup.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate.

    Null and empty texts have no words and stay; repeated rows share their fate; an empty benchmark rejects nothing.
    """
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data.

    Null texts stay null; equal texts stay equal; an entity has one surrogate in all documents.
    """
    return pii.replace_pii(docs, pii.session_key(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their token ids, bucket by bucket within a partition.

    Null and empty texts are the end id alone; a null doc_id stays null; repeated rows are packed as often as they occur.
    """
    small_batches(spark)
    pieces = packing.pack(docs, public_tokenizers.path(packing.VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "ids")


STAGES = [("quality", quality), ("near_dedup", dedup), ("decontaminate", clean), ("pii", private), ("packing", packed)]

#: Robust covariance estimates and tokenization are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
