"""The corpus pipeline: five stages over ``documents``, each written and read again by whoever drives it.

All stages take whole texts of any length, repeated rows and rows without an id as rows of their own, ignore columns that
``documents`` doesn't have (also such as clash with their own), and give an empty table for an empty one. Rows of
equal columns are interchangeable. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import language, mixing, neardup, pieces, secrets
from folio.llm.common import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents without a language that can be told go; ``lang`` is what was identified.

    Null and empty texts, and texts with few letters, go. Of equally likely languages the first by code point is told.
    A null declared language or source is no evidence of its own.
    """
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near copies (five words, 0.8) the lowest doc_id stays, a null one before all.

    Null and empty texts stay, as they are near nothing. Of rows of one id in a group, one stays: that of the least hash of
    its columns; of wholly equal rows any one.
    """
    return neardup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: secrets are masked; every document stays, null texts as null, and ``n_chars`` follows where a text changed."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: each document as often as it was drawn, shard by shard, shuffled within shards.

    Documents without words, null texts among them, are never drawn. Null sources are one source, the last. Rows of equal id
    and source are drawn alike. Within a shard ties of the order go by id.
    """
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: ids of whole texts, with the proof of the round trip. Null texts count as empty and have no ids."""
    return pieces.encode(docs)


STAGES = [
    ("language ID", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("source mixing", mix_sources),
    ("piece encoding", encode_pieces),
]

#: Learned language models, hashes and ids of pieces are no SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, one after another."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
