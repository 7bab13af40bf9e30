"""Rollups of an index: statistics, languages, layers, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

FAN_OUT, SPAN = 6, 60


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), F.nullif(b, F.lit(0)).cast("double")), F.lit(0.0))


def index_stats(files: DataFrame, symbols: DataFrame, edges: DataFrame, line_count: DataFrame) -> DataFrame:
    """One row: files, symbols, imports edges, lines (``line_count`` has one row ``lines``)."""
    return (
        files.agg(F.count("*").alias("files"))
        .join(F.broadcast(symbols.agg(F.count("*").alias("symbols"))))
        .join(F.broadcast(edges.agg(F.count_if(F.col("kind") == "imports").alias("imports"))))
        .join(F.broadcast(line_count.agg(F.sum("lines").alias("lines"))))
    )


def languages(files: DataFrame) -> DataFrame:
    """Files per language with their share of all, in the order of languages."""
    known = files.where("language is not null")
    total = known.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    rows = known.groupBy("language").agg(F.count("*").alias("n_files")).join(F.broadcast(total))
    order = F.array_position(F.array(*map(F.lit, P.LANGUAGE_ORDER)), F.col("language"))
    return rows.select(
        "language", "n_files", F.round(100.0 * F.col("n_files") / F.col("total"), 6).alias("percent"), order.cast("int").alias("place")
    )


def layers(files: DataFrame) -> DataFrame:
    """Files per architecture layer, only layers that have some."""
    rows = files.groupBy(P.layer(F.col("path")).alias("layer")).agg(F.countDistinct("file_id").alias("n_files"))
    return rows.select("layer", P.label_of(F.col("layer")).alias("label"), "n_files", P.layer_order(F.col("layer")).alias("place"))


def outline(files: DataFrame) -> DataFrame:
    """Groups of layers with their layers listed."""
    rows = layers(files).withColumn("group", P.group_of(F.col("layer")))
    return rows.groupBy("group").agg(
        F.sum("n_files").alias("n_files"),
        F.array_sort(F.collect_list(F.struct("place", "layer", "n_files"))).alias("layers"),
    ).withColumn("place", P.group_order(F.col("group")))


def complexity(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: (min(mean calls / 6, 1) + min(mean span / 60, 1)) / 2 over functions and methods."""
    calls = edges.where("kind = 'calls'").groupBy(F.col("source_id").alias("symbol_id")).agg(F.count("*").alias("calls"))
    rows = symbols.where("kind in ('function', 'method')").join(calls, "symbol_id", "left")
    fan = F.avg(F.coalesce("calls", F.lit(0)))
    span = F.avg(F.greatest(F.col("end_line") - F.col("start_line"), F.lit(1)))
    score = (F.least(fan / FAN_OUT, F.lit(1.0)) + F.least(span / SPAN, F.lit(1.0))) / 2
    return rows.agg(F.round(F.coalesce(score, F.lit(0.0)), 6).alias("complexity"))


def health(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts and shares."""
    path = F.col("path")
    of_files = files.agg(
        F.count("*").alias("files"),
        F.countDistinct("language").alias("languages"),
        F.count_if(P.is_test(path)).alias("test_files"),
        F.count_if(P.layer(path) != "other").alias("mapped_files"),
    )
    placed = symbols.join(files.select("file_id", "path"), "file_id")
    endpoint = F.col("kind").isin("function", "method", "component") & P.is_route(path)
    of_symbols = placed.agg(F.count("*").alias("symbols"), F.count_if(P.is_test(path)).alias("test_symbols"), F.count_if(endpoint).alias("endpoints"))
    of_edges = edges.agg(F.count_if(F.col("kind") == "imports").alias("dependencies"))
    every = of_files.join(F.broadcast(of_symbols)).join(F.broadcast(of_edges)).join(F.broadcast(complexity(symbols, edges)))
    return every.select(
        "files", "languages", "symbols", "test_files", "test_symbols", "endpoints", "dependencies", "complexity",
        F.round(ratio(F.col("mapped_files"), F.col("files")), 6).alias("mapped"),
        F.round(ratio(F.col("test_files"), F.col("files")), 6).alias("test_presence"),
    )
