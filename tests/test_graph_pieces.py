"""Edges in pieces of bounded size, and steps over edges that repeat."""

from __future__ import annotations

from lodestone.operators import graph
from lodestone.plans import views


def test_pieces_grow_in_number_with_the_table(spark, tmp_path, monkeypatch):
    spark.range(4000).selectExpr("id div 4 as a", "id % 3 as b", "id as c").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(views, "PIECE_ROWS", 100)
    found = views.distinct_pairs(rows, "a", "b")
    assert found.rdd.getNumPartitions() == 41
    assert sorted(map(tuple, found.collect())) == sorted({(i // 4, i % 3) for i in range(4000)})


def test_steps_take_repeated_edges(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("d", "c", "contains")] * 5, "source_id string, target_id string, kind string")
    found = graph.impact(edges, "a")
    assert sorted(map(tuple, found.collect())) == [("a", 0), ("b", 2), ("c", 1)]
    hops = graph.Hops(edges)
    assert hops.rows.count() == 20  # written as they are: nothing holds all of them to drop repeats
    around = graph.neighborhood(edges, "b", 1)
    assert sorted(map(tuple, around.collect())) == [("a", 1), ("b", 0), ("c", 1)]
