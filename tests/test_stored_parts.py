"""A query over stored tables makes only those that it reads; vectors are counted a batch at once."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa

from lodestone.functions import vectors as V
from lodestone.plans import code_queries

FOLDER = "/root/testdata/sf0.001"


def test_semantic_search_makes_no_postings(spark):
    code_queries.Stored.MADE.clear()
    assert code_queries.semantic_search_stored(spark, FOLDER).count() == 16
    assert {"lexicon", "adjacent", "edges"}.isdisjoint(vars(code_queries.Stored.of(spark, FOLDER)))
    assert code_queries.exact_search_stored(spark, FOLDER).count()
    stored = vars(code_queries.Stored.of(spark, FOLDER))
    assert "lexicon" in stored and "adjacent" not in stored


def test_vectors_of_a_batch():
    texts = ["retry Retry the payment", None, "", "a b", "xUnit 42 42 42", "the"]
    for dimensions in (256, 7):
        got = V.vectors_of(pa.array(texts, pa.string()), dimensions).to_pylist()
        for text, vector in zip(texts, got):
            want = Counter(V.fnv1a_bucket(t.lower(), dimensions) for t in V.TOKEN.findall(text or "") if len(t) >= 2)
            assert vector == {"entries": [{"bucket": k, "n": n} for k, n in sorted(want.items())], "ss": sum(n * n for n in want.values())}
    assert V.vectors_of(pa.array([], pa.string()), 256).to_pylist() == []
