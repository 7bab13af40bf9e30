"""Graph operators over an edge table (source_id, target_id, kind) and a node table.

nodes: symbol_id, name, kind, path, file_id. Multi-hop operators advance one
level per Spark job; the visited set is written to the shared folder each level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from .adjacency import SMALL, Stored
from .persist import persisted

# fixed values
DEPENDENT_KINDS = ("calls", "imports", "references", "extends", "implements")
MAX_DEPTH = 16
MAX_NODES = 400
GAP_X, GAP_Y = 188, 118
COMPACT = 48


def of_kind(edges: DataFrame, kind: str | None) -> DataFrame:
    return edges if kind is None else edges.where(F.col("kind") == kind)


def neighbors(edges: DataFrame, node: str, kind: str | None = None) -> DataFrame:
    return of_kind(edges, kind).where(F.col("source_id") == node).select(F.col("target_id").alias("symbol_id"), "kind")


def incoming(edges: DataFrame, node: str, kind: str | None = None) -> DataFrame:
    return of_kind(edges, kind).where(F.col("target_id") == node).select(F.col("source_id").alias("symbol_id"), "kind")


def described(found: DataFrame, nodes: DataFrame) -> DataFrame:
    return found.join(nodes.select("symbol_id", "name", F.col("kind").alias("symbol_kind"), "path"), "symbol_id")


def dependencies(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """What a node depends on: one hop, containment left out, distinct."""
    return described(neighbors(edges, node).where("kind <> 'contains'").distinct(), nodes)


def dependents(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    return described(incoming(edges, node).where("kind <> 'contains'").distinct(), nodes)


def related(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Dependents and dependencies together, distinct by node and kind."""
    return dependents(edges, nodes, node).unionByName(dependencies(edges, nodes, node)).dropDuplicates(["symbol_id", "kind"])


def degrees(edges: DataFrame) -> DataFrame:
    """In plus out edges of all kinds, for nodes that have any."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("symbol_id"))
    return ends.groupBy("symbol_id").agg(F.count("*").alias("degree"))


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends in a set of nodes (symbol_id)."""
    sources, targets = kept.select(F.col("symbol_id").alias("source_id")), kept.select(F.col("symbol_id").alias("target_id"))
    return edges.join(sources, "source_id", "left_semi").join(targets, "target_id", "left_semi").select(*edges.columns)


def compact_view(edges: DataFrame, nodes: DataFrame, limit: int = COMPACT) -> DataFrame:
    """The nodes of highest degree."""
    ranked = degrees(edges).join(nodes.select("symbol_id", "name", "kind", "path"), "symbol_id")
    return ranked.orderBy(F.desc("degree"), "name", "symbol_id").limit(limit)


def adjacency(edges: DataFrame) -> DataFrame:
    """Targets of each source, in order."""
    return edges.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("target_id", "kind"))).alias("targets"))


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """Rows with their place (from 1) in a stated order, and how many there are: sorted by ranges, no task has all of them."""
    dealt = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = persisted(dealt, "numbered")
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row per partition
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets += [F.lit(part), F.lit(before)]
        before += sizes[part]
    if not sizes:
        return dealt.drop("_part").withColumn("idx", F.lit(0).cast("long")), 0
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("idx", (within + F.element_at(F.create_map(*offsets), F.col("_part"))).cast("long")).drop("_part"), before


class Hops:
    """Steps over edges that aren't stored for it: they are written once, repeats and all, as a level groups what it finds."""

    def __init__(self, edges: DataFrame):
        self.rows = persisted(edges.select(F.col("source_id").alias("from_id"), F.col("target_id").alias("symbol_id")), "hops")

    def step(self, frontier: DataFrame, size: int) -> DataFrame:
        return self.rows.join(F.broadcast(frontier) if size <= SMALL else frontier, "from_id")


def reach(hops: Hops | Stored, starts: DataFrame, depth: int, max_nodes: int | None = None) -> DataFrame:
    """(symbol_id, depth): breadth-first from ``starts`` (symbol_id).

    With ``max_nodes`` a level stops before the first node, in breadth-first
    order, that finds so many nodes visited already.
    """
    visited = persisted(starts.select("symbol_id").distinct().select("symbol_id", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("place")), "reach")
    done = size = visited.count()
    for level in range(1, depth + 1):
        frontier = visited.where(F.col("depth") == level - 1).select(F.col("symbol_id").alias("from_id"), F.col("place").alias("from_place"))
        found = hops.step(frontier, size).join(visited.select("symbol_id"), "symbol_id", "left_anti")
        first = found.groupBy("symbol_id").agg(F.min("from_place").alias("from_place"))
        if max_nodes is not None:
            if done >= max_nodes:
                break
            first, found_now = numbered(first, "from_place", "symbol_id")
            if not found_now:
                break
            # the nodes found from one node are in a row; those whose turn comes after the limit find none
            turns = first.groupBy("from_place").agg(F.min("idx").alias("turn")).where(F.col("turn") - 1 + done < max_nodes)
            first = first.join(turns.select("from_place"), "from_place", "left_semi")
            place = F.col("idx") + done
        else:
            place = F.lit(0).cast("long")
        new = persisted(first.select("symbol_id", F.lit(level).alias("depth"), place.alias("place")), "reach")
        size = new.count()
        if not size:
            break
        done += size
        visited = visited.unionByName(new)
    return visited.select("symbol_id", "depth")


def one(spark: SparkSession, node: str) -> DataFrame:
    return spark.createDataFrame([(node,)], "symbol_id string")


def neighborhood(edges: DataFrame, node: str, depth: int, stored: DataFrame | None = None) -> DataFrame:
    """Nodes within ``depth`` hops of a node, in either direction, all kinds; ``stored`` is the edges' adjacency table."""
    if stored is not None:
        hops = Stored(stored, ("out", "in"))
    else:
        hops = Hops(edges.select("source_id", "target_id").unionByName(edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))))
    return reach(hops, one(edges.sparkSession, node), max(depth, 1))


def impact(edges: DataFrame, node: str, max_nodes: int | None = MAX_NODES, depth: int = MAX_DEPTH, stored: DataFrame | None = None) -> DataFrame:
    """(symbol_id, depth) of what depends on a node, directly (1) or not; the node itself has depth 0."""
    if stored is not None:
        hops = Stored(stored, ("in",), DEPENDENT_KINDS)
    else:
        back = edges.where(F.col("kind").isin(*DEPENDENT_KINDS))
        hops = Hops(back.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")))
    return reach(hops, one(edges.sparkSession, node), depth, max_nodes)


def impact_report(edges: DataFrame, nodes: DataFrame, node: str, max_nodes: int | None = None, stored: DataFrame | None = None) -> DataFrame:
    """The impact set with names, and which lists each dependent is in; whole, unless ``max_nodes`` ends the search."""
    found = impact(edges, node, max_nodes, stored=stored).join(nodes, "symbol_id")
    path = F.col("path")
    return found.select(
        "symbol_id",
        "name",
        "path",
        "depth",
        (F.col("depth") == 1).alias("direct"),
        (F.col("depth") > 1).alias("indirect"),
        (P.is_test(path) & (F.col("depth") > 0)).alias("is_test"),
        (P.is_route(path) & (F.col("depth") > 0)).alias("is_route"),
        (P.is_component(path, F.col("name"), F.col("kind")) & (F.col("depth") > 0)).alias("is_component"),
    )


def impact_files(report: DataFrame) -> DataFrame:
    """Impacted files with their symbols and roles."""
    grouped = report.groupBy("path").agg(F.count("*").alias("symbols"), F.bool_or("is_component").alias("any_component"))
    return grouped.select("path", "symbols", P.roles(F.col("path"), F.col("any_component")).alias("roles"))


def impact_tree(report: DataFrame) -> DataFrame:
    """One row: the origin with its dependents as sorted children."""
    entry = F.struct("depth", "name", "symbol_id")
    return report.agg(
        F.min(F.when(F.col("depth") == 0, F.struct("path", "name"))).alias("origin"),
        F.array_sort(F.collect_list(F.when(F.col("depth") > 0, entry))).alias("children"),
    )


def signed_layers(edges: DataFrame, node: str, depth: int) -> DataFrame:
    """(symbol_id, layer) in a bounded view: +1 along an edge, -1 against it, the first assignment holds.

    Within a level, targets are assigned before sources.
    """
    steps = (
        edges.select(F.col("source_id").alias("from_id"), F.col("target_id").alias("symbol_id"), F.lit(1).alias("step"))
        .unionByName(edges.select(F.col("target_id").alias("from_id"), F.col("source_id").alias("symbol_id"), F.lit(-1).alias("step")))
        .distinct()
    )
    spark = edges.sparkSession
    known = persisted(spark.createDataFrame([(node, 0, 0)], "symbol_id string, layer int, level int"), "layers")
    for level in range(1, depth + 1):
        front = known.where(F.col("level") == level - 1).select(F.col("symbol_id").alias("from_id"), F.col("layer").alias("from_layer"))
        found = front.join(steps, "from_id").join(known.select("symbol_id"), "symbol_id", "left_anti")
        chosen = F.min(F.struct((-F.col("step")).alias("o"), (F.col("from_layer") + F.col("step")).alias("layer")))
        new = persisted(found.groupBy("symbol_id").agg(chosen["layer"].alias("layer")).withColumn("level", F.lit(level)), "layers")
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known.select("symbol_id", "layer")


def compact_layout(edges: DataFrame, view: DataFrame) -> DataFrame:
    """``layout`` of a compact view around its best connected node; what that doesn't lead to lies in its layer."""
    first = view.orderBy(F.desc("degree"), "name", "symbol_id").first()
    if first is None:
        return layout(view.select("symbol_id", F.lit(0).alias("layer")), view)
    layers = signed_layers(induced(edges, view), first["symbol_id"], view.count())  # a view has 48 nodes
    every = view.select("symbol_id").join(layers, "symbol_id", "left")
    return layout(every.select("symbol_id", F.coalesce("layer", F.lit(0)).alias("layer")), view)


def layout(layers: DataFrame, nodes: DataFrame) -> DataFrame:
    """Coordinates: layers in rows, the nodes of a layer centred by name and id."""
    rows = layers.join(nodes.select("symbol_id", "name"), "symbol_id")
    own = Window.partitionBy("layer")
    index = F.row_number().over(own.orderBy("name", "symbol_id")) - 1
    count = F.count("*").over(own)
    return rows.select(
        "symbol_id",
        "layer",
        (index * GAP_X - count * GAP_X / 2 + GAP_X / 2).cast("double").alias("x"),
        (F.col("layer") * GAP_Y).cast("double").alias("y"),
    )
