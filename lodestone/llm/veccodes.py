"""Near-duplicate embeddings: binary codes of randomly rotated vectors decide which pairs are computed exactly.

A vector of length one is turned by a random rotation (signs and a Walsh-Hadamard
step, three times) and coded by the signs of its components: one bit each. With
the code its inner product with the vector itself is stored, the correction
factor f. For another vector q the product with the code, c, then gives the
estimate c / f of the inner product, free of bias over rotations. c is taken from
the code and q's components rounded to four bits, plane by plane with AND and bit
counts; q's stored rounding error e bounds what that leaves out.

A pair is computed exactly in double precision unless one of two bounds rules it
out. For certain, the angle between q and the vector is at least the angle
between q and the code less that between the vector and its code. With
confidence, the estimate is off by at most ``epsilon`` * sqrt(1 - f^2) /
(f * sqrt(d - 1)); 6 leaves out one pair in 30 million, and at 64 dimensions the
certain bound is the tighter one. No pair below the threshold is linked.

Pairs are made in tasks, never as rows. Rows of one label and vector length are
dealt into groups of at most ``group_numbers`` components on average, and every
two groups of a label meet in a cell of their own, so a label that holds most of
the rows is spread over many tasks. A cell returns one row per vector that has
links in it: their number, and the least id its links in the cell lead to. Equal vectors of a label are
compared once, with their number. Components are joined by star operations.

One row per row comes back. Defined results: a vector that is null, zero, or
holds null or non-finite components, or whose label is null, links with nothing,
nor do vectors of different lengths; an empty table gives none; other columns are
ignored. A repeated id is one vector, the row with the least label and then
vector of those that take part; all rows of the id get its result. A null id links
with nothing, its component is null and it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, small_batches
from .components import components

THRESHOLD = 0.93
EPSILON = 6.0
PLANES = 4
GROUP_NUMBERS = 1 << 21
TILE = 1 << 19
SEED = 20
SLACK = 1e-5


def rotated(rows: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Rows (zeros added up to a power of two) under one random rotation for all rows of a length."""
    n, dim = rows.shape
    wide = max(64, 1 << (dim - 1).bit_length())
    out = np.zeros((n, wide))
    out[:, :dim] = rows
    draw = np.random.default_rng([seed, dim])
    for _ in range(3):
        out *= draw.integers(0, 2, wide) * 2 - 1
        step = 1
        while step < wide:
            pairs = out.reshape(n, wide // (2 * step), 2, step)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, wide)
            step *= 2
        out /= np.sqrt(wide)
    return out


class Codes:
    """Vectors of one length: as they are (length one), their sign codes and the codes' products with them."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, unit: np.ndarray, bits: np.ndarray, factor: np.ndarray):
        self.ids, self.copies, self.unit, self.bits, self.factor = ids, copies, unit, bits, factor

    def __len__(self) -> int:
        return len(self.ids)


def coded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes as 64-bit words, correction factors) of unit vectors."""
    turned = rotated(rows)
    bits = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
    return bits, np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def queries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors rounded to four bits: (planes, low, step, rounding error), value = low + step * number."""
    turned = rotated(rows)
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / ((1 << PLANES) - 1), 1e-3)
    numbers = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    off = np.linalg.norm(turned - low[:, None] - step[:, None] * numbers, axis=1)
    planes = np.stack([np.packbits((numbers >> b) & 1, axis=1, bitorder="little").view(np.uint64) for b in range(PLANES)])
    return planes, low, step, off


def limits(factor: np.ndarray, dim: int, threshold: float, epsilon: float) -> np.ndarray:
    """The least product with its code that a vector at the threshold can have."""
    f = np.clip(factor, 0, 1)
    certain = np.cos(np.minimum(np.arccos(f) + np.arccos(threshold), np.pi))
    likely = threshold * f - epsilon * np.sqrt((1 - f * f) / max(dim - 1, 1))
    return np.maximum(certain, likely) - SLACK


def linked(a: Codes, b: Codes, threshold: float, epsilon: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) places of linked pairs, in tiles of bounded size; of one and the same Codes each pair i < j once."""
    if not len(a) or not len(b):
        return
    words = b.bits.shape[1]
    wide = words * 64
    limit = limits(b.factor, wide, threshold, epsilon)
    ones = np.bitwise_count(b.bits).sum(axis=1, dtype=np.int64)
    tall = max(1, min(len(a), TILE // min(len(b), 4096)))
    for top in range(0, len(a), tall):
        planes, low, step, off = queries(a.unit[top : top + tall])
        own = np.arange(top, min(top + tall, len(a)))
        # the sum of sign * value over the components is 2 * (sum where the bit is set) - (sum of all)
        total = low * wide + step * sum((1 << p) * np.bitwise_count(planes[p]).sum(axis=1, dtype=np.int64) for p in range(PLANES))
        root = np.sqrt(wide)
        sides = np.stack([root / (2 * step), (total - root * off) / (2 * step) - 0.01, -low / step], axis=1).astype(np.float32)
        start = top if a is b else 0
        for left in range(start, len(b), 4096):
            part = slice(left, min(left + 4096, len(b)))
            bits = b.bits[part]
            counts = np.zeros((len(own), len(bits)), np.uint16)
            for p in range(PLANES):
                for w in range(words):
                    counts += np.bitwise_count(planes[p, :, None, w] & bits[None, :, w]).astype(np.uint16) << p
            # product * sqrt(wide) = 2 * (low * ones + step * counts) - total; compared as counts, so one step a pair
            least = sides @ np.stack([limit[part], np.ones(len(bits)), ones[part]]).astype(np.float32)
            i, j = np.nonzero(counts >= least)
            i, j = own[i], j + left
            if a is b:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 1 << 16):
                x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                exact = np.einsum("ij,ij->i", a.unit[x], b.unit[y]) >= threshold
                if exact.any():
                    yield x[exact], y[exact]


class Groups:
    """Least place reached by links, kept as places."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                further = self.root[self.root]
                if (further == self.root).all():
                    break
                self.root = further


def cell_links(a: Codes, b: Codes, threshold: float, epsilon: float) -> pa.RecordBatch:
    """(vec_id, n, least): what each vector of a cell is linked with; ``a`` and ``b`` may be the same."""
    same = a is b
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    copies = a.copies if same else np.concatenate([a.copies, b.copies])
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    groups, counts, move = Groups(len(ids)), np.zeros(len(ids), np.int64), 0 if same else len(a)
    for i, j in linked(a, b, threshold, epsilon):
        j = j + move
        counts += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
        groups.join(place[i], place[j])
    own = np.flatnonzero(counts)
    least = ids[order][groups.root[place[own]]]
    return pa.record_batch([pa.array(ids[own]), pa.array(counts[own]), pa.array(least)], ["vec_id", "n", "least"])


def vectors(df: DataFrame) -> DataFrame:
    """(vec_id, label, vector): one row per id that can have links, the vector as an array of doubles."""
    v = F.col("embedding").cast("array<double>")
    plain = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), v.alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    able = plain.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(~bad & some)
    # one zero: -0.0 and 0.0 are the same component
    even = able.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    return even.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")


def with_codes(distinct: DataFrame) -> DataFrame:
    """Distinct vectors with their length-one form, code and correction factor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vector"))
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            unit, code, factor = [b""] * len(sizes), [b""] * len(sizes), np.zeros(len(sizes))
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                rows = flat[starts[own][:, None] + np.arange(dim)]
                rows = rows / np.abs(rows).max(axis=1)[:, None]
                rows = rows / np.linalg.norm(rows, axis=1)[:, None]
                bits, f = coded(rows)
                for k, i in enumerate(own.tolist()):
                    unit[i], code[i] = rows[k].tobytes(), bits[k].tobytes()
                factor[own] = f
            yield pa.record_batch(
                [*(batch.column(batch.schema.get_field_index(c)) for c in ("label", "vec_id", "copies")), pa.array(sizes.astype(np.int32)),
                 pa.array(unit, pa.binary()), pa.array(code, pa.binary()), pa.array(factor)],
                ["label", "vec_id", "copies", "dim", "unit", "code", "factor"],
            )

    kind = distinct.schema["label"].dataType.simpleString()
    return distinct.mapInArrow(run, f"label {kind}, vec_id long, copies long, dim int, unit binary, code binary, factor double")


def cells(rows: DataFrame, group_numbers: int) -> DataFrame:
    """Rows once for each cell of two groups that they enter: (label, dim, low, high, own) added."""
    # only labels larger than a group are listed, fewer than rows / group size
    large = rows.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("groups", F.ceil(F.col("n") * F.col("dim") / group_numbers).cast("int"))
    dealt = rows.join(large.where("groups > 1").select("label", "dim", "groups"), ["label", "dim"], "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    own = dealt.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("groups")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    return other.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other", "groups")


def links(rows: DataFrame, threshold: float, epsilon: float, group_numbers: int) -> DataFrame:
    """(vec_id, n, least) per cell and vector with links in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def taken(parts: list) -> Codes:
            dim = key[1]
            return Codes(
                np.concatenate([p.column("vec_id").to_numpy() for p in parts]),
                np.concatenate([p.column("copies").to_numpy() for p in parts]),
                np.frombuffer(b"".join(v for p in parts for v in p.column("unit").to_pylist())).reshape(-1, dim),
                np.frombuffer(b"".join(v for p in parts for v in p.column("code").to_pylist()), np.uint64).reshape(-1, max(64, 1 << (dim - 1).bit_length()) // 64),
                np.concatenate([p.column("factor").to_numpy() for p in parts]),
            )

        def close() -> Iterator[pa.RecordBatch]:
            if key is None or key[2] != key[3] and len(held) < 2 or key[2] == key[3] and sum(map(len, held[key[2]])) < 2:
                return
            sides = [taken(held[k]) for k in sorted(held)]
            out = cell_links(sides[0], sides[-1], threshold, epsilon)
            if out.num_rows:
                yield out

        for batch in batches:
            names = [batch.column(c).to_pylist() for c in ("label", "dim", "low", "high", "own")]
            places = list(zip(*names))
            at = 0
            while at < len(places):
                stop = at
                while stop < len(places) and places[stop] == places[at]:
                    stop += 1
                if places[at][:4] != key:
                    yield from close()
                    key, held = places[at][:4], {}
                held.setdefault(places[at][4], []).append(batch.slice(at, stop - at))
                at = stop
        yield from close()

    dealt = cells(rows, group_numbers).repartition("label", "dim", "low", "high").sortWithinPartitions("label", "dim", "low", "high", "own")
    return dealt.mapInArrow(run, "vec_id long, n long, least long")


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, epsilon: float = EPSILON, group_numbers: int = GROUP_NUMBERS) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept."""
    spark = df.sparkSession
    small_batches(spark)
    one = materialize(vectors(df), "vectors")
    same = one.groupBy("label", "vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    distinct = materialize(same, "distinct")
    found = materialize(links(with_codes(distinct), threshold, epsilon, group_numbers), "cell-links")
    roots = components(found.where("vec_id <> least").select(F.col("vec_id").alias("a"), F.col("least").alias("b")))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    whole = distinct.join(counts, "vec_id", "left").join(roots, F.col("vec_id") == F.col("node"), "left")
    lookup = whole.select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    own = one.join(lookup, ["label", "vector"]).select(F.col("vec_id").alias("own_id"), "n_links", "component_id")
    every = df.select(F.col("vec_id").cast("long").alias("vec_id")).join(own, F.col("vec_id") == F.col("own_id"), "left")
    component = F.coalesce("component_id", "vec_id")
    out = every.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
    out = materialize(out, "near-embeddings")
    release(one, distinct, found)
    return out
