"""Files, symbols and semantic units: the tables that everything else reads.

files: file_id, path, language, size_bytes, hash, text
symbols: symbol_id, file_id, ord, name, kind, start_line, end_line, container
units: symbol_id, file_id, ord, name, kind, path, language, start_line, end_line, text
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X

SYMBOL_KINDS = ("function", "method", "class", "struct", "enum", "trait", "interface", "component", "constant", "variable")
EDGE_KINDS = ("imports", "calls", "extends", "implements", "references", "contains")


def check_kind(kind: str | None) -> None:
    if kind is not None and kind not in SYMBOL_KINDS:
        raise ValueError(f"unknown symbol kind: {kind}")


def symbols_with_files(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with path and language; symbols without a file drop out."""
    return symbols.join(files.select("file_id", "path", "language"), "file_id")


def build_units(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """A unit per symbol with its snippet; sensitive files, blank snippets and secrets give none."""
    sources = files.where(~P.is_sensitive(F.col("path")) & F.col("text").isNotNull()).select(
        "file_id", "path", "language", X.lines(F.col("text")).alias("all_lines")
    )
    own = ("symbol_id", "ord", "name", "kind", "start_line", "end_line")
    # a file's symbols meet its lines in one row, where the snippets are cut; only these leave it
    listed = symbols.groupBy("file_id").agg(F.collect_list(F.struct(*own)).alias("symbols"))
    lines = F.col("all_lines")
    cut = F.transform("symbols", lambda s: F.struct(s.alias("s"), X.snippet(lines, s["start_line"], s["end_line"]).alias("text")))
    return (
        sources.join(listed, "file_id")
        .select("file_id", "path", "language", F.explode(cut).alias("u"))
        .select("u.s.symbol_id", "file_id", "u.s.ord", "u.s.name", "u.s.kind", "path", "language", "u.s.start_line", "u.s.end_line", "u.text")
        .where((F.trim("text", F.lit(" \t\n\r")) != "") & ~X.looks_like_secret(F.col("text")))
    )


def first_units(symbols: DataFrame, units: DataFrame) -> DataFrame:
    """Each symbol with the text of its first unit, empty where there is none."""
    first = units.groupBy("symbol_id").agg(F.min(F.struct("ord", "text"))["text"].alias("unit_text"))
    return symbols.join(first, "symbol_id", "left").withColumn("unit_text", F.coalesce("unit_text", F.lit("")))


def dedup_keep_first(rows: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key in a stated order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def like_search(symbols: DataFrame, files: DataFrame, query: str, limit: int = 200) -> DataFrame:
    """Symbols whose name is LIKE %query%, without regard to case; % and _ in the query are wildcards."""
    return (
        symbols_with_files(symbols, files)
        .where(F.lower("name").like(f"%{query.lower()}%"))
        .orderBy("name", "symbol_id")
        .limit(limit)
    )


def files_by_directory(files: DataFrame) -> DataFrame:
    return files.groupBy(P.directory(F.col("path")).alias("directory")).agg(
        F.count("*").alias("n_files"), F.array_sort(F.collect_list(P.base_name(F.col("path")))).alias("names")
    )


def check_limits(files: DataFrame, max_file: int = 1 << 20, max_files: int = 100_000, max_bytes: int = 512 << 20) -> DataFrame:
    """The files within the size limit; too many files or bytes are an error."""
    kept = files.where((F.col("size_bytes") <= max_file) & (F.col("size_bytes") > 0))
    total = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b")).first()
    if total["n"] > max_files or total["b"] > max_bytes:
        raise ValueError(f"too many files ({total['n']}) or bytes ({total['b']})")
    return kept
