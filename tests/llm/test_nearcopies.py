"""The pipeline's near-copy stage against all pairs of exact shingle sets."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import nearcopies

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS)


def shingles(text):
    words = brute.space_words((text or "").translate(brute.ASCII_LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def first_ids(texts):
    sets, root = {i: shingles(t) for i, t in texts}, {i: i for i, _ in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return set(root.values())


@pytest.mark.parametrize("block", [2048, 2])
def test_edited_copies_like_brute_force(spark, monkeypatch, block):
    """Blocks of two nodes cut every cell."""
    monkeypatch.setattr(nearcopies, "BLOCK_NODES", block)
    rng = random.Random(4)
    prose = lambda n: [f"w{rng.randint(0, 2000)}" for _ in range(n)]
    texts = [(i, " ".join(prose(rng.randint(0, 90)))) for i in range(30)]
    for group in range(8):
        base = prose(200)
        for k in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(200)] = f"x{rng.randint(0, 2000)}"
            texts.append((100 + 10 * group + k, " ".join(copy)))
    texts += [(300, None), (301, ""), (302, " \n"), (303, "One two"), (304, "one  TWO")]
    kept = corpus_pipeline.drop_near_copies(spark, documents(spark, texts), "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = first_ids(texts)
    assert {r.doc_id for r in kept.collect()} == want
    assert len(want) < 60


def test_repeated_and_null_ids(spark):
    long = " ".join(f"w{k}" for k in range(120))
    rows = [(1, long), (2, long.replace("w60 ", "v60 ")), (2, "another text of that id stays"), (None, long), (1, long)]
    kept = corpus_pipeline.drop_near_copies(spark, documents(spark, rows), "").collect()
    assert sorted((str(r.doc_id), r.text[:7]) for r in kept) == [("1", "w0 w1 w"), ("1", "w0 w1 w"), ("2", "another"), ("None", "w0 w1 w")]
    assert corpus_pipeline.drop_near_copies(spark, documents(spark, [(1, "")]).limit(0), "").count() == 0


def test_links_of_two_blocks_join_the_components_of_all_pairs():
    """``joining`` over every two blocks of a cell against all pairs; pairs that share an earlier band are left to it."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 100, np.uint64)
    sets = []
    for _ in range(40):
        own = base.copy()
        own[rng.choice(100, rng.integers(0, 25), replace=False)] = rng.integers(0, 1 << 62, 1, np.uint64)
        sets.append(np.unique(own))
    fp, root = np.arange(40), np.arange(40)
    cells = np.arange(40)[:, None] + np.zeros((1, nearcopies.BANDS), int) * 1000
    blocks = np.split(np.arange(40), [9, 22])
    found = []
    for i in range(3):
        for j in range(i, 3):
            at = blocks[i] if i == j else np.concatenate([blocks[i], blocks[j]])
            some = nearcopies.joining(fp[at], root[at], cells[at], 4, len(blocks[i]), [sets[k] for k in at])
            assert len(some) < len(at)
            found += some
    every = [(a, b) for a in range(40) for b in range(a) if nearcopies.alike(sets[a], sets[b])]
    assert grouped(found, 40) == grouped(every, 40) and len(set(grouped(every, 40))) > 1
    same = np.zeros((40, nearcopies.BANDS), int)
    assert not nearcopies.joining(fp, root, same, 1, 40, sets)
    assert nearcopies.joining(fp, root, same, 0, 40, sets)
    assert not nearcopies.joining(fp, root * 0, cells, 0, 40, sets)


def grouped(links, n):
    root = list(range(n))
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    return root
