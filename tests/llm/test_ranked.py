"""Ranked search against scores of all documents in plain integers."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from lodestone.llm import ranked

from .brute import ASCII_LOWER

DOCS, ITEMS = "doc_id long, text string, ids string, counts int", "item_id string, text string, terms string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(ASCII_LOWER))


def expected(docs, items, k=20):
    bags = [(i, Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    count, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            m = 100 - 25 + (25 * sum(bag.values()) * count) // total
            score = 0
            for t in terms(text):
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m))
            if score > 0:
                scores.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def found(spark, docs, items, **options):
    a = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS).repartition(5)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    df = ranked.search(a, b, **options)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("options", [{}, {"block_bytes": 2000, "shard_postings": 700}])
def test_like_all_documents_scored(spark, options):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Élan", "ÉLAN", "a_b", "x2"]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([4, 64])]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 90))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)] + [(2000, text(30_000)), (2001, None), (2002, ""), (2003, "!?"), (-5, docs[7][1].upper())]
    items = [(f"q{i}", text(rng.randint(1, 25))) for i in range(25)] + [("none", None), ("empty", " "), ("other", "unheard of"), ("twice", "w1 w1 w1 w2")]
    assert found(spark, docs, items, **options) == expected(docs, items)


def test_ties_repeats_nulls_and_empty_tables(spark):
    docs = [(3, "a b"), (3, "a b"), (1, "a b"), (None, "a b a"), (2, "c")]
    items = [("q", "a"), (None, "a"), ("r", "b"), ("r", "a b")]
    same = [(i, t) for i, t in docs if i is not None]
    assert found(spark, docs, items) == expected(same, [("q", "a"), ("r", "a b")])
    assert found(spark, docs, items, k=2) == expected(same, [("q", "a"), ("r", "a b")], 2)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []


def test_bytes_bound_every_part_of_a_score():
    parts = range(0, 1_000_000, 7)
    assert all(b <= 255 and (b - 1) * ranked.STEP + (b > 0) <= p <= b * ranked.STEP for p in parts for b in [-(-p // ranked.STEP)])
