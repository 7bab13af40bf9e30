"""Components in pieces, and how the classifier's sample gets to the driver."""

from __future__ import annotations

import random

import pytest

from lodestone.llm import components as module
from lodestone.llm import quality


def plain_roots(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("size", [1 << 17, 40])
def test_components_by_pieces(spark, monkeypatch, size):
    rng = random.Random(5)
    edges = [(rng.randint(-300, 300), rng.randint(-300, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    monkeypatch.setattr(module, "PIECE_EDGES", size)
    made, materialize = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, label: made.append(label) or materialize(df, label))
    got = [(r.node, r.root) for r in module.components(spark.createDataFrame(edges + edges[:9], "a long, b long")).collect()]
    assert len(got) == len(set(got)) and dict(got) == plain_roots(edges)
    assert (len(made) == 2) == (size > len(edges))


def test_sample_comes_without_row_objects(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"plain words {i} stay" if i % 2 else f"junk {i} !!") for i in range(40)] + [(40, ""), (41, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(42)], "doc_id long, quality int")
    kind, seen = type(docs), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: seen.append(self.columns) or collect(self))
    model = quality.train(docs, labels)
    assert seen and not any("found" in names for names in seen)
    assert model.score(quality.features(b"plain words 7 stay")) > model.score(quality.features(b"junk 8 !!"))
