"""How often retrieval reads its tables, and the scores it takes from batches of texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import vectors as V
from lodestone.operators import retrieval


def watched(spark, rows):
    """A table with a count of its rows that were read."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return rows.mapInArrow(run, rows.schema), seen


def some_units(spark, n=40):
    rows = spark.range(n).select(
        F.format_string("s%02d", "id").alias("symbol_id"), F.lit("f").alias("file_id"), F.col("id").cast("int").alias("ord"), F.format_string("retryPayment%d", "id").alias("name"),
        F.lit("function").alias("kind"), F.lit("src/a.ts").alias("path"), F.lit("typescript").alias("language"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"),
        F.format_string("charge the card %d\nfailed payment", "id").alias("text"),
    )
    return rows


def test_edges_are_read_once(spark):
    edges, seen = watched(spark, spark.range(39).select(F.format_string("s%02d", "id").alias("source_id"), F.format_string("s%02d", F.col("id") + 1).alias("target_id"), F.lit("calls").alias("kind")))
    found = retrieval.retrieve(some_units(spark), edges, "Where is the failed payment retried?").collect()
    assert len(found) == 5 and seen.value == 39


def test_adjoining(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "a"), ("a", "a"), ("x", "y")], "source_id string, target_id string")
    assert sorted(r[0] for r in retrieval.adjoining(edges, ["a"]).collect()) == ["a", "a", "b", "c"]
    assert not retrieval.adjoining(edges, []).collect()


def test_texts_hold_strings(spark):
    rows = spark.createDataFrame([("The PAY-ment\nfails",), ("KEY İn",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(X.held(F.col("t"), ["pay", "fail", "key", "in"])).collect()] == [2, 0, 0, 0]
    assert [r[0] for r in rows.select(X.held(F.col("t"), [])).collect()] == [0] * 4


@pytest.mark.parametrize("bins", [V.BINS, 3 * 256])
def test_products_are_those_of_the_vectors(spark, monkeypatch, bins):
    import pyarrow as pa

    monkeypatch.setattr(V, "BINS", bins)
    texts = ["a retry of aRetry\nof it", "", None, "Of it\nof it\n", "x", "retry " * 3000]
    vectors = V.vectors_of(pa.array(texts, pa.string()), 256).to_pylist()
    for text, own in zip(texts, vectors):
        expected = {}
        for t in V.TOKEN.findall(text or ""):
            if len(t) >= 2:
                k = V.fnv1a_bucket(t.lower())
                expected[k] = expected.get(k, 0) + 1
        assert {e["bucket"]: e["n"] for e in own["entries"]} == expected and own["ss"] == sum(n * n for n in expected.values())
    asked = {V.fnv1a_bucket("retry"): 2, V.fnv1a_bucket("it"): 1}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(V.products(F.col("t"), asked).alias("p"))
    assert [tuple(r.p) for r in rows.collect()] == [(sum(e["n"] * asked.get(e["bucket"], 0) for e in v["entries"]), v["ss"]) for v in vectors]
