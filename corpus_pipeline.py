"""A corpus pipeline: quality rules, exact and near dedup, source mixing, tokenization.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read back as the next stage's docs.  All but the last return the columns of
`documents`.

Odd input has defined results in every stage: null texts count as empty, null ids are
kept apart from every number, repeated rows and ties are rows like others unless a stage
drops copies, very long texts are worked whole (in pieces where that helps), columns of
any names are carried along, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossmill.llm import byte_bpe, exact_dedup, mixing, quality_rules, simhash
from glossmill.llm.common import settle, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest keep.

    Null, empty and very short texts fail the base rules and go.  Each row is judged by
    itself, so ties and repeated rows share their verdict; very long texts are judged
    whole.  Without good labels the forest rejects nothing.
    """
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the largest doc_id.

    Null texts equal empty ones; a null id is below every number; of rows that tie on the
    id, or are repeated whole, one stays.  Texts of any length count whole.
    """
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal fingerprints, the one with the smallest doc_id.

    Links are those of the operator, within three bits, under each of `simhash.LANES` hash
    functions and over shingles of `simhash.STAGE_SHINGLE` words, under which most copies of
    a five-word similarity of 0.8 or more lie that near.  Texts without words are one group; a group without
    ids keeps one row; ties and repeated rows keep one; texts of any length count whole.
    """
    return simhash.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it.

    Null sources are one source, null and empty texts have size 0, rows without ids are
    told apart by their text, and repeated rows are drawn one by one.
    """
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text.

    Null and empty texts have no ids; rows map one to one, whatever their ids; very long
    texts are split in pieces that don't change the ids.
    """
    return byte_bpe.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", encoding_stage),
]

#: The quality forest, the fingerprints and the encoder have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the result of every stage but the last is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
