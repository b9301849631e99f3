"""From raw documents to token digests: language ID, exact dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, exact_dedup, langid, mixing, simhash
from quillspark.storage import materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told: null and empty texts, and texts without a letter.

    If no row has a language to learn from, documents with letters stay. Repeated rows are judged each by
    itself; columns may have any names; an empty table stays empty.
    """
    return langid.known_language(docs, langid.fit_language_model(docs, ~langid.held_out() & F.col("doc_id").isNotNull()))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the row with the largest id; see :func:`exact_dedup.keep_one` for nulls and repeated rows."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, by fingerprints (as op2) or by five-word shingles (Jaccard 0.8).

    See :func:`simhash.keep_one_similar` for nulls, empty texts and repeated rows.
    """
    return simhash.keep_one_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and leave out documents so that sources meet their targets; see :func:`mixing.repeat_documents`."""
    return mixing.repeat_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text and decode it again: a row for each row, in whatever number; a null text is the empty one."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: SQL cannot express the learned, fingerprint and encoding stages; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each but the last written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
