"""A stored index for lexical search: what units hold, found without reading their texts.

A search token is letters and digits, so it lies within one run of letters and
digits of a text. The index has two tables:

postings: bucket, run, symbol_id, ord, first. One row per unit and distinct
    lower-cased run of its name and text; ``first`` is the first unit of its symbol.
grams: bucket, gram, run. One row per distinct run and piece of two or three
    characters: the runs in which a token may lie.

Both are partitioned by a hash bucket of their key and sorted by it. A search
reads the grams that its tokens begin with, keeps the runs that hold a token, and
reads the postings of these runs.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower

BUCKETS = 32


def bucket(key: Column) -> Column:
    return F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(BUCKETS)).cast("int")


def bucket_of(key: str) -> int:
    return zlib.crc32(key.encode()) % BUCKETS


def postings(units: DataFrame) -> DataFrame:
    both = ascii_lower(F.concat("name", F.lit("\n"), "text"))
    runs = F.array_distinct(F.regexp_extract_all(both, F.lit("[a-z0-9]+"), F.lit(0)))
    first = units.groupBy("symbol_id").agg(F.min("ord").alias("first_ord"))
    rows = units.select("symbol_id", "ord", F.explode(runs).alias("run")).join(first, "symbol_id")
    return rows.select(bucket(F.col("run")).alias("bucket"), "run", "symbol_id", "ord", (F.col("ord") == F.col("first_ord")).alias("first"))


def grams(posted: DataFrame) -> DataFrame:
    """The pieces of all runs of ``postings``."""
    runs = posted.select("run").distinct().where(F.length("run") >= 2)
    pieces = lambda n: F.when(F.length("run") >= n, F.transform(F.sequence(F.lit(1), F.length("run") - n + 1), lambda i: F.substr(F.col("run"), i, F.lit(n))))
    every = F.array_distinct(F.concat(pieces(2), F.coalesce(pieces(3), F.array().cast("array<string>"))))
    rows = runs.select("run", F.explode(every).alias("gram"))
    return rows.select(bucket(F.col("gram")).alias("bucket"), "gram", "run")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows as they are stored: a bucket's rows together, in the order of their key."""
    return rows.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", key)


class Lexicon:
    """The two tables of one repository."""

    def __init__(self, posted: DataFrame, pieces: DataFrame):
        self.postings, self.grams = posted, pieces

    def hits(self, tokens: list[str]) -> DataFrame:
        """(token, symbol_id, ord, first): the units whose name or text holds a token."""
        leads = sorted({t[:3] for t in tokens})
        asked = F.array(*map(F.lit, tokens)).cast("array<string>")
        held = F.filter(asked, lambda t: (F.substring(t, 1, 3) == F.col("gram")) & F.contains(F.col("run"), t))
        read = self.grams.where(F.col("bucket").isin(*sorted({bucket_of(g) for g in leads})) & F.col("gram").isin(*leads))
        runs = read.select("run", F.explode(held).alias("token")).withColumn("bucket", bucket(F.col("run")))
        return self.postings.join(runs, ["bucket", "run"]).select("token", "symbol_id", "ord", "first").distinct()
