"""Edges as they are stored for traversal: by the node that a step leaves from, in both directions.

adjacency: way ('out' along an edge, 'in' against it), bucket, from_id, to_id,
kind. Partitioned by way and hash bucket and sorted by node; a bucket is written
by several tasks, so a hub lies in several files. A step reads the buckets of its
frontier and no others, and the edges aren't shuffled while the frontier is small
enough to be sent to them; a larger one is joined by its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .postings import BUCKETS, bucket

PIECES = 4
SMALL = 50_000
"""A frontier of so many ids is sent to all executors, about 4 MB."""


def adjacency(edges: DataFrame) -> DataFrame:
    out = edges.select(F.lit("out").alias("way"), F.col("source_id").alias("from_id"), F.col("target_id").alias("to_id"), "kind")
    back = edges.select(F.lit("in").alias("way"), F.col("target_id").alias("from_id"), F.col("source_id").alias("to_id"), "kind")
    every = out.unionByName(back).select("way", bucket(F.col("from_id")).alias("bucket"), "from_id", "to_id", "kind")
    piece = F.pmod(F.xxhash64("to_id"), F.lit(PIECES))
    return every.repartition(BUCKETS, "way", "bucket", piece).sortWithinPartitions("way", "bucket", "from_id")


class Stored:
    """Steps over a stored adjacency table, for ``graph.reach``."""

    def __init__(self, table: DataFrame, ways: tuple[str, ...], kinds: tuple[str, ...] | None = None):
        rows = table.where(F.col("way").isin(*ways))
        self.rows = rows if kinds is None else rows.where(F.col("kind").isin(*kinds))

    def step(self, frontier: DataFrame, size: int) -> DataFrame:
        """(from_id, from_place, symbol_id) one edge on from ``frontier`` (from_id, from_place)."""
        front = frontier.withColumn("bucket", bucket(F.col("from_id")))
        read = sorted(r["bucket"] for r in front.select("bucket").distinct().collect())  # as many as there are buckets at most
        near = self.rows.where(F.col("bucket").isin(*read)).select("bucket", "from_id", F.col("to_id").alias("symbol_id"))
        return near.join(F.broadcast(front) if size <= SMALL else front, ["bucket", "from_id"]).drop("bucket")
