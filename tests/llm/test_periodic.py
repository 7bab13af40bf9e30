"""Periodic runs against all periods tried at all places."""

from __future__ import annotations

import random
import time
import zlib

import pytest

from lodestone.llm import periodic

from .brute import sha, space_words

DOCS = "doc_id long, text string, runs string, collapsed int"


def every_run(w, min_length, min_exponent=3):
    n, out = len(w), set()
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i > start and i + q - start >= max(min_length, min_exponent * q):
                run = w[start : i + q]
                if not any(run[r:] == run[:-r] for r in range(1, q)):
                    out.add((start, len(run), q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(seed, count=3000, most=70):
    rng = random.Random(seed)
    for _ in range(count):
        n, k = rng.randint(0, most), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randint(1, k) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n else 0):
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            for i in range(a, rng.randint(a, n)):
                w[i] = w[a + (i - a) % p]
        yield w


@pytest.mark.parametrize("least", [1, 3, 5, 24])
def test_runs_like_all_periods(least):
    for w in texts(least):
        assert periodic.find_runs(w, least) == every_run(w, least)


def test_lyndon_edges_like_sorted_suffixes():
    for w in texts(99, 400, 40):
        found = {i: (j, k) for i, j, k in periodic.lyndon_edges(w)}
        for i in range(len(w)):
            j = next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), None)
            assert (i in found) == (j is not None)
            if j is not None:
                k = 0
                while j + k < len(w) and w[i + k] == w[j + k]:
                    k += 1
                assert found[i] == (j, k)


@pytest.mark.parametrize("kind", ["ones", "fibonacci", "blocks"])
def test_hard_texts_take_linear_time(kind):
    def made(n):
        if kind == "ones":
            return [1] * n
        if kind == "blocks":
            return (([1] * 400 + [2]) * (n // 401 + 1))[:n]
        a, b = [1], [1, 2]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]

    took = []
    for n in (20_000, 160_000):
        w, began = made(n), time.process_time()
        periodic.runs_of(w)
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 0.5


def report(doc_id, text):
    words = space_words(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = every_run(words, 24)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_report_like_its_definition(spark):
    rng = random.Random(6)
    rows = [(i, " \t".join(f"é{x}" for x in w)) for i, w in enumerate(texts(6, 250, 90))]
    line = " ".join(f"w{rng.randint(0, 40)}" for _ in range(30))
    rows += [(900, None), (901, ""), (902, " \n "), (903, "one"), (None, line), (None, None), (5, line), (5, line), (904, (line + " ") * 9 + "tail"), (905, "a b " * 30)]
    rows += [(i, " ".join(f"u{rng.randint(0, 9)}" for _ in range(rng.randint(1, 300)))) for i in range(1000, 1080)]
    rows += [(2000, " ".join(f"w{k % 1999}" for k in range(9000)))]
    got = periodic.run_report(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(3))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((report(i, t) for i, t in rows), key=str)


def test_empty_table_and_operator_output(spark):
    empty = spark.createDataFrame([], DOCS)
    assert periodic.run_report(empty).collect() == []
    row = periodic.periodic_runs(spark.createDataFrame([(1, "x " + "a b " * 15 + "y", "", 0)], DOCS)).first()
    assert [tuple(r) for r in row.runs] == [(1, 30, 2)] and row.collapsed == "x a b y"
    with pytest.raises(ValueError):
        periodic.periodic_runs(empty, min_exponent=2)
