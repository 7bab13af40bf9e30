"""Connected components: edges are contracted in pieces of bounded size, alternating star operations join the pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, splittable

PIECE_EDGES = 1 << 17
"""A piece has about as many edges: pieces grow in number with a table, not in size."""


def contracted(edges: DataFrame, pieces: int) -> DataFrame:
    """Edges (a, b) of the same components: in each piece, every node but the least of its component is linked to that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def least(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = above.get(up, up)
                x = up
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = least(a), least(b)
                if a != b:
                    above[max(a, b)] = min(a, b)
        if above:
            yield pa.record_batch([pa.array(list(above), pa.int64()), pa.array([least(x) for x in above], pa.int64())], ["a", "b"])

    whole = edges.coalesce(1) if pieces == 1 else edges.repartition(pieces)
    return whole.mapInArrow(run, "a long, b long")


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (a > b): neighbours are linked to the least of a node's neighbourhood.

    Large: the larger neighbours of each node. Small: the node and its smaller neighbours.
    """
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(splittable(least, "u"), "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of long values -> one row (node, root) per node that has an edge.

    The root is the least node of the component. Edges may repeat and may run
    either way. Edges that make one piece are done when it is contracted; several
    pieces go on in rounds. Every round is written to the shared folder, so no lineage
    grows and a lost executor costs one round; the number of rounds grows with the
    logarithm of a component's size.
    """
    found = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    pieces = found.count() // PIECE_EDGES + 1
    now = materialize(contracted(found, pieces), "edges")
    release(found)
    seen = None
    while pieces > 1:
        summary = now.agg(
            F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if summary == seen:
            break
        seen = summary
        new = materialize(star(star(now, large=True), large=False), "edges")
        release(now)
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
