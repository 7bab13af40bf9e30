"""SimHash near-duplicates, substring deduplication, components."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lodestone.llm import simhash, substrings
from lodestone.llm.components import components

from . import brute

DOCS = "doc_id long, text string, fp string, spans string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", len(t or "")) for i, t in texts], DOCS)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("seed", range(2))
def test_links_like_brute_force(spark, seed):
    rng = random.Random(seed)
    prints = {0, (1 << 64) - 1, 1, 3, 7}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            v = base
            for _ in range(rng.randint(0, 4)):
                v ^= 1 << rng.randrange(64)
            prints.add(v)
    values = sorted(map(signed, prints))
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.root for r in components(simhash.links(df)).collect()}
    by_index = brute.components({k: v & (2**64 - 1) for k, v in enumerate(values)})
    assert {v: got.get(v, v) for v in values} == {values[k]: values[r] for k, r in by_index.items()}


def test_links_stay_linear_in_a_ball(spark):
    centre = 0x5A5A_0F0F_3333_1248
    ball = {centre} | {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
    df = spark.createDataFrame([(signed(v),) for v in ball], "fp long")
    edges = simhash.links(df)
    assert edges.count() <= 65 * len(ball)
    assert {r.root for r in components(edges).collect()} == {min(map(signed, ball))}


def test_near_duplicates_like_brute_force(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randint(0, 300)}" for _ in range(n))
    texts = [(i, text(rng.randint(0, 80))) for i in range(60)]
    texts += [(100 + i, t.upper().replace(" ", " \n\t")) for i, t in texts[:20]]
    long = text(3000)
    texts += [(200, long), (201, long + " end"), (202, long.replace("w7 ", "w8 ", 1)), (203, None), (204, ""), (205, "  \n"), (206, "one"), (207, "ONE"), (208, "a b"), (209, "É é")]
    rows = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = {i: brute.fingerprint(t) for i, t in texts}
    assert {i: r.fingerprint for i, r in rows.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in rows.items()} == brute.components(prints)
    kept = simhash.keep_first(documents(spark, texts))
    assert kept.columns == ["doc_id", "text", "fp", "spans", "n_chars"]
    assert {r.doc_id for r in kept.collect()} == set(brute.components(prints).values())


def test_near_duplicates_defined_cases(spark):
    rows = simhash.near_duplicates(documents(spark, [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "zz"), (7, "A b c D")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("5", "5"), ("5", "5"), ("7", "5"), ("None", "5"), ("None", "None")]
    assert simhash.near_duplicates(documents(spark, [(1, "")]).limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(7, 3), (5, 5)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(i, 0) for i in range(301)}
    assert components(edges.limit(0)).count() == 0


def check_substrings(spark, texts):
    docs = documents(spark, texts)
    gone = brute.repeated_words(dict(texts))
    rows = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.kept_words(docs).collect()}
    want = {}
    for i, t in texts:
        words = brute.space_words(t)
        kept = [w for w, g in zip(words, gone[i], strict=True) if not g]
        want[i] = (len(words), sum(gone[i]), brute.sha(" ".join(kept)))
    assert rows == want
    import re

    out = {r.doc_id: r for r in substrings.remove(docs).collect()}
    for i, t in texts:
        if gone[i] and all(gone[i]):
            assert i not in out
        elif t is not None and any(gone[i]):
            places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
            assert out[i].text == brute.without(t, places, gone[i])
            assert out[i].n_chars == len(out[i].text)
        else:
            assert out[i].text == t


@pytest.mark.parametrize("seed", range(3))
def test_substrings_like_brute_force(spark, seed):
    rng = random.Random(seed)
    alphabet = ["a", "b"] if seed == 0 else [f"w{k}" for k in range(40)] + ["é", "Wort"]
    passages = [[rng.choice(alphabet) for _ in range(rng.randint(10, 60))] for _ in range(8)]
    texts = []
    for i in range(50):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(alphabet) for _ in range(rng.randint(0, 40))]
            if rng.random() < 0.3 and words:
                words[rng.randrange(len(words))] = "changed"
        texts.append((i * 3, rng.choice(["", " "]) + rng.choice([" ", "\n", " \t"]).join(words)))
    texts += [(1000, None), (1001, ""), (1002, " ".join(["x"] * 13)), (1003, " ".join(["x"] * 40)), (1004, " ".join(["x"] * 12))]
    check_substrings(spark, texts)


def test_substrings_hot_passage_and_long_text(spark):
    rng = random.Random(3)
    hot = " ".join(f"h{k}" for k in range(30))
    long = " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(60_000))
    texts = [(i, f"start{i} {hot} end{i}") for i in range(300)] + [(500, long), (501, f"{hot} x {long[:4000]}")]
    check_substrings(spark, texts)


def test_substrings_defined_cases(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    rows = substrings.kept_words(documents(spark, [(None, passage), (None, passage), (4, passage), (4, passage), (9, passage)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in rows) == [("4", 0), ("4", 0), ("9", 20), ("None", 0), ("None", 0)]
    assert substrings.kept_words(documents(spark, [(1, "a")]).limit(0)).count() == 0


def test_substrings_compare_words_not_hashes(spark):
    """The Thue-Morse word and its complement collide under every hash of the module; nothing of them repeats."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"r{k}" for k in range(12))
    hashes = substrings.Words([word.encode(), other.encode()], 2).hashes
    assert all(h[0] == h[1] for h in hashes)
    texts = [(1, f"{word} {rest}"), (2, f"{other} {rest}"), (3, f"new {other} {rest} more"), (4, f"{word} {rest}")]
    check_substrings(spark, texts)
    check_substrings(spark, [(1, f"{word} {rest} {word} tail"), (2, f"{other} {rest} {word} tail"), (3, f"x y z {other} {rest} {other} tail")])


def test_substrings_of_an_id_with_two_texts(spark):
    shared = " ".join(f"s{k}" for k in range(20))
    long = f"{shared} " + " ".join(f"l{k}" for k in range(40))
    rows = [(1, shared), (2, long), (2, "short one"), (2, long), (3, f"short one {long[40:]}"), (2, f"only here {shared}")]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.kept_words(documents(spark, rows)).collect())
    first = {1: [shared], 2: [long, long, "short one", f"only here {shared}"], 3: [rows[4][1]]}
    want = []
    for i, texts in first.items():
        before = " | ".join(t for j, ts in first.items() if j < i for t in ts).replace("|", "\0")
        for t in texts:
            want.append((i, len(t.split()), sum(brute.repeated_words({0: before, 1: t})[1])))
    assert got == sorted(want)
    assert len(substrings.remove(documents(spark, rows)).collect()) == 6


def test_word_hashes_depend_on_words_alone():
    a = substrings.Words([b"one two  three", b"four\none two three"], 2)
    for k in range(2):
        assert a.hashes[k][0] == a.hashes[k][4] and a.hashes[k][2] == a.hashes[k][6]
        three = a.spans(k, np.array([0, 4]), 3)
        assert three[0] == three[1]
    assert a.first_word.tolist() == [0, 3, 7]
