"""The corpus pipeline: five stages over ``documents``, each written and read again.

STAGES is a list of (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, nearcopies, pieces_bpe, quality, registry, simhash, substrings
from lodestone.llm.common import materialize, release, scratch, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    registry.ship(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Groups are those of op 4's SimHash fingerprints; of what these leave, edited copies are found by their shingles too.
    """
    registry.ship(spark)
    return nearcopies.keep_first(materialize(simhash.keep_first(docs), "simhash-kept"))


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has."""
    registry.ship(spark)
    return substrings.remove(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that consist of them go."""
    registry.ship(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded text."""
    registry.ship(spark)
    return pieces_bpe.encode_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("simhash", drop_near_copies),
    ("substrings", drop_repeated_spans),
    ("decontaminate", drop_benchmark),
    ("sentencepiece", encode),
]

ORACLE_SQL = None  # a fitted classifier and XXH64 fingerprints have no SQL; tests/llm holds the brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch() as kept:
            out = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            kept.append(out)
        release(docs)
        docs = out
    return docs
