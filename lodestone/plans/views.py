"""The driver's tables seen as files, symbols, units, history and a graph.

Each view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..operators.persist import persisted
from ..operators.units import build_units
from .base import DIRECTORIES, KINDS, SUFFIXES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is read; documents in fewer pieces than there are cores are dealt to all of these."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name == "documents" and rows.rdd.getNumPartitions() < cores else rows


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per document: its path from the id, its text as the source."""
    docs = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    path = F.concat(
        pick(DIRECTORIES, doc % len(DIRECTORIES)), F.lit("/m"), doc.cast("string"), pick(SUFFIXES, doc % len(SUFFIXES))
    )
    rows = docs.select(doc, F.concat(F.lit("f"), doc.cast("string")).alias("file_id"), path.alias("path"), "text")
    return rows.select(
        "doc_id", "file_id", "path", P.language(F.col("path")).alias("language"), F.octet_length("text").cast("long").alias("size_bytes"),
        F.md5("text").alias("hash"), "text",
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol per line that has a word, named after it."""
    rows = files(spark, sf_dir).select("doc_id", "file_id", X.lines(F.col("text")).alias("ls"))
    each = rows.select("doc_id", "file_id", F.size("ls").alias("n"), F.posexplode("ls").alias("pos", "line"))
    pos = F.col("pos") + 1
    named = each.withColumn("name", F.regexp_extract("line", "[A-Za-z0-9]+", 0)).where("name <> ''")
    return named.select(
        F.concat(F.lit("s"), F.col("doc_id").cast("string"), F.lit("-"), pos.cast("string")).alias("symbol_id"), "file_id",
        pos.alias("ord"), "name", pick(KINDS, pos % 10).alias("kind"), pos.alias("start_line"),
        F.least(pos + F.col("doc_id") % 7, F.col("n")).cast("int").alias("end_line"),
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_units(symbols(spark, sf_dir), files(spark, sf_dir))


def stored_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units as an index holds them: written once, for queries that read them more than once."""
    return persisted(units(spark, sf_dir), "units")


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits, customers as authors, parts as paths."""
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.array_sort(F.collect_set(F.concat(F.lit("p/"), F.col("l_partkey").cast("string")))).alias("paths")
    )
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = F.col("o_orderkey")
    email = F.concat(F.when(key % 2 == 0, "U").otherwise("u"), F.col("c_custkey").cast("string"), F.lit("@mail"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(parts, F.col("k") == key)
    return rows.select(
        key.cast("int").alias("ord"), F.concat(F.lit("c"), key.cast("string")).alias("sha"), F.col("c_name").alias("author_name"), email.alias("author_email"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("authored_at"), F.concat(F.lit("change "), key.cast("string")).alias("subject"), "paths",
    )


def name_of(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


PIECE_ROWS = 500_000
"""Rows of a piece within which repeats are dropped: pieces grow in number with a table, not in size."""


def distinct_pairs(rows: DataFrame, first: str, second: str) -> DataFrame:
    """The distinct pairs of two columns; few repeat, so rows are dealt by the first before any are grouped."""
    pieces = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // PIECE_ROWS + 1)
    return rows.select(first, second).repartition(pieces, first).distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as a graph."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customers, suppliers, nations = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))

    def edge(rows: DataFrame, source: Column, target: Column, kind: str) -> DataFrame:
        return rows.select(source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("kind"))

    parts = [
        edge(distinct_pairs(items, "l_orderkey", "l_partkey"), name_of("order", "l_orderkey"), name_of("part", "l_partkey"), "calls"),
        edge(distinct_pairs(items, "l_orderkey", "l_suppkey"), name_of("order", "l_orderkey"), name_of("supp", "l_suppkey"), "references"),
        edge(orders, name_of("cust", "o_custkey"), name_of("order", "o_orderkey"), "imports"),
        edge(customers, name_of("cust", "c_custkey"), name_of("nation", "c_nationkey"), "extends"),
        edge(suppliers, name_of("supp", "s_suppkey"), name_of("nation", "s_nationkey"), "extends"),
        edge(nations, name_of("region", "n_regionkey"), name_of("nation", "n_nationkey"), "contains"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [
        ("orders", "order", "o_orderkey", F.concat(F.lit("Order"), F.col("o_orderkey").cast("string")), "function", "src/api/o", ".ts"),
        ("part", "part", "p_partkey", F.col("p_name"), "class", "src/db/p", ".rs"),
        ("supplier", "supp", "s_suppkey", F.col("s_name"), "struct", "src/services/s", ".py"),
        ("customer", "cust", "c_custkey", F.col("c_name"), "function", "src/components/c", ".tsx"),
        ("nation", "nation", "n_nationkey", F.col("n_name"), "enum", "src/tests/n", ".ts"),
        ("region", "region", "r_regionkey", F.col("r_name"), "trait", "lib/r", ".js"),
    ]
    out = None
    for source, prefix, key, name, kind, head, tail in specs:
        path = F.concat(F.lit(head), F.col(key).cast("string"), F.lit(tail))
        rows = table(spark, sf_dir, source).select(
            name_of(prefix, key).alias("symbol_id"), name.alias("name"), F.lit(kind).alias("kind"), path.alias("path")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def unit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol calls the next of its file."""
    rows = symbols(spark, sf_dir).select("symbol_id", "file_id", "ord")
    after = rows.select(F.col("symbol_id").alias("target_id"), "file_id", (F.col("ord") - 1).alias("ord"))
    return rows.join(after, ["file_id", "ord"]).select(F.col("symbol_id").alias("source_id"), "target_id", F.lit("calls").alias("kind"))


def stored_unit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as an index holds them, for queries that read them more than once."""
    return persisted(unit_edges(spark, sf_dir), "edges")
