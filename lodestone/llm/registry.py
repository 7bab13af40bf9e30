"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontaminate,
    mainblocks,
    oracles,
    periodic,
    pieces_bpe,
    quality,
    ranked,
    simhash,
    substrings,
    tokencounts,
    topk,
    urlfilter,
    veccodes,
    warc,
)
from .common import table

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, unless their path has it already."""
    path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sent = getattr(spark.sparkContext, "_lodestone_sent", False)
    if sent or str(ROOT) in path or not ROOT.is_dir():
        return
    archive = Path(tempfile.mkdtemp()) / "lodestone.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((ROOT / "lodestone").rglob("*.py")):
            out.write(file, file.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    sys.path.remove(str(archive)) if str(archive) in sys.path else None
    spark.sparkContext._lodestone_sent = True


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainblocks.extract(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_bpe.encode_documents(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.kept_words(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccodes.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_quality,
    op2_token_counts,
    op3_topk_search,
    op4_simhash,
    op5_main_text,
    op6_decontaminate,
    op7_sentencepiece,
    op8_substring_dedup,
    op9_warc,
    op10_url_filters,
    op11_embedding_dedup,
    op12_ranked_search,
    op13_periodic_runs,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return query(spark, sf_dir)

        return run

    return {q.__name__: shipped(q) for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
