"""Near-duplicate embeddings against all pairs computed exactly."""

from __future__ import annotations

import numpy as np
import pytest

from lodestone.llm import veccodes

ROWS = "vec_id long, embedding array<float>, label int, n long, least long, unit string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, k, 1, 2, "x") for i, v, k in rows], ROWS)


def expected(rows, threshold=0.93):
    """{id: (links, component)} by comparing all pairs; ids must not repeat."""
    able = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, np.float32).astype(float)
        able[i] = (label, x / np.linalg.norm(x))
    links = {i: set() for i, _, _ in rows if i is not None}
    for i, (k, a) in able.items():
        for j, (m, b) in able.items():
            if i < j and k == m and len(a) == len(b) and float(a @ b) >= threshold:
                links[i].add(j)
                links[j].add(i)
    root = {}
    for i in sorted(links):
        todo = [] if i in root else [i]
        while todo:
            j = todo.pop()
            if j not in root:
                root[j] = i
                todo += links[j]
    return {i: (len(links[i]), root[i]) for i in links}


def answered(df):
    rows = df.collect()
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return {r.vec_id: (r.n_links, r.component_id) for r in rows}


def made(rng, n, dim, labels=3):
    base = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = base[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.25, 0.33])
        rows.append((int(i * 3 + 1), [float(x) for x in v.astype(np.float32)], int(rng.integers(labels))))
    return rows


@pytest.mark.parametrize("numbers", [1 << 21, 900])
def test_like_all_pairs(spark, numbers):
    rng = np.random.default_rng(3)
    rows = made(rng, 260, 64) + [(10_000 + i, v[:40], k) for i, v, k in made(rng, 60, 64)]
    df = table(spark, rows).repartition(5)
    got = answered(veccodes.near_duplicates(df, group_numbers=numbers))
    assert got == expected(rows)
    assert any(n > 3 for n, _ in got.values())


def test_rows_that_link_with_nothing(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (5, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, [1.0, 2.0, 3.0], 2), (6, None, 1), (7, [0.0, -0.0, 0.0], 1), (8, [1.0, None, 3.0], 1),
        (9, [float("nan"), 2.0, 3.0], 1), (10, [float("inf"), 2.0, 3.0], 1), (11, v, None), (12, [], 1), (13, [1.0, 2.0], 1), (14, [-1.0, -2.0, -3.0], 1),
        (15, [1e-30, 2e-30, 3e-30], 1), (16, [1e30, 2e30, 3e30], 1),
    ]
    assert answered(veccodes.near_duplicates(table(spark, rows))) == expected(rows)


def test_repeated_and_null_ids_and_an_empty_table(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (1, None, 1), (2, [0.0, 1.0], 1), (None, [0.0, 1.0], 1), (3, [1.0, 0.01], 1)]
    got = sorted(map(tuple, veccodes.near_duplicates(table(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, 1, True)] * 3 + [(2, 1, 1, False), (None, 0, None, True), (3, 0, 3, True)], key=str)
    assert veccodes.near_duplicates(table(spark, [])).collect() == []


def test_copies_are_counted_not_compared(spark):
    rng = np.random.default_rng(5)
    v, w = ([float(x) for x in rng.normal(size=16)] for _ in range(2))
    rows = [(i, v, 1) for i in range(700)] + [(1000 + i, w, 1) for i in range(300)]
    distinct = table(spark, rows).groupBy("label", "embedding").count().count()
    assert distinct == 2
    got = answered(veccodes.near_duplicates(table(spark, rows)))
    assert set(got.values()) == {(699, 0), (299, 1000)}


def test_estimates_have_no_bias_and_bounds_hold():
    rng = np.random.default_rng(8)
    a = rng.normal(size=128)
    b = 0.8 * a + 0.6 * rng.normal(size=128)
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    off = []
    for seed in range(300):
        turned = veccodes.rotated(np.stack([a, b]), seed)
        assert np.allclose(np.linalg.norm(turned, axis=1), 1)
        code = np.sign(turned[0]) / np.sqrt(128)
        factor, product = code @ turned[0], code @ turned[1]
        assert a @ b <= np.cos(max(0, np.arccos(product) - np.arccos(factor))) + 1e-12
        off.append(product / factor - a @ b)
    assert abs(np.mean(off)) < 4 * np.std(off) / np.sqrt(len(off))
    assert np.max(np.abs(off)) < veccodes.EPSILON * np.sqrt((1 - factor**2) / factor**2 / 127)
