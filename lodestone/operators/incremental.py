"""Re-indexing by snapshot difference: what to skip, parse, merge and reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resolve import clean


def plan_files(previous: DataFrame, current: DataFrame, changed: DataFrame | None = None, dropped: DataFrame | None = None) -> DataFrame:
    """(path, action): dropped, skipped_by_diff, skipped_by_hash or parse.

    ``changed`` and ``dropped`` are what a version-control diff lists, if there
    is one. A known file that such a diff doesn't list is skipped unread, unless
    its hash differs, so that a file that was dirty and went back isn't stale.
    """
    old = previous.select("path", F.col("hash").alias("old_hash"), F.lit(True).alias("known"))
    new = current.select("path", F.col("hash").alias("new_hash"), F.lit(True).alias("present"))
    rows = old.join(new, "path", "full_outer")
    listed = F.lit(True)
    if changed is not None:
        rows = rows.join(changed.select("path", F.lit(True).alias("listed")).distinct(), "path", "left")
        listed = F.coalesce("listed", F.lit(False))
    gone = F.col("present").isNull()
    if dropped is not None:
        rows = rows.join(dropped.select("path", F.lit(True).alias("gone")).distinct(), "path", "left")
        gone = gone | (F.coalesce("gone", F.lit(False)) & F.col("present").isNull())
    same = F.col("known").isNotNull() & (F.col("old_hash") == F.col("new_hash"))
    action = F.when(gone, "dropped").when(same & ~listed, "skipped_by_diff").when(same, "skipped_by_hash").otherwise("parse")
    return rows.select("path", action.alias("action"))


def live(symbols: DataFrame, files: DataFrame) -> DataFrame:
    return symbols.join(files.select("file_id"), "file_id", "left_semi")


def live_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with both ends among the symbols."""
    ids = symbols.select("symbol_id")
    kept = edges.join(ids.withColumnRenamed("symbol_id", "source_id"), "source_id", "left_semi")
    return kept.join(ids.withColumnRenamed("symbol_id", "target_id"), "target_id", "left_semi").select(*edges.columns)


def merge_symbols(old: DataFrame, fresh: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    """Old symbols of live, unchanged files, and the fresh ones of changed files."""
    kept = live(old, files).join(changed.select("file_id"), "file_id", "left_anti")
    return kept.select(*old.columns).unionByName(fresh.select(*old.columns))


def merge_edges(old: DataFrame, fresh: DataFrame, symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """Old edges from unchanged files whose ends are live, and the fresh ones, without repeats."""
    moved = symbols.join(changed.select("file_id"), "file_id", "left_semi").select(F.col("symbol_id").alias("source_id"))
    kept = live_edges(old, symbols).join(moved, "source_id", "left_anti").select(*old.columns)
    return clean(kept.unionByName(fresh.select(*old.columns)))


def reuse_units(old: DataFrame, rebuilt: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    kept = live(old, files).join(changed.select("file_id"), "file_id", "left_anti")
    return kept.select(*old.columns).unionByName(rebuilt.select(*old.columns))


def reuse_embeddings(vectors: DataFrame, units: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors that can stay, and the units that need new ones."""
    moved = units.join(changed.select("file_id"), "file_id", "left_semi").select("symbol_id")
    kept = vectors.join(units.select("symbol_id"), "symbol_id", "left_semi").join(moved, "symbol_id", "left_anti")
    return kept, units.join(kept.select("symbol_id").distinct(), "symbol_id", "left_anti")


def line_count(files_lines: DataFrame, skipped_symbols: DataFrame | None = None) -> DataFrame:
    """One row ``lines``: the lines of parsed files, and of skipped ones as far as their symbols reach."""
    parsed = files_lines.agg(F.coalesce(F.sum("n_lines"), F.lit(0)).alias("lines"))
    if skipped_symbols is None:
        return parsed
    known = skipped_symbols.groupBy("file_id").agg(F.max("end_line").alias("n"))
    return parsed.unionByName(known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))).agg(F.sum("lines").alias("lines"))
