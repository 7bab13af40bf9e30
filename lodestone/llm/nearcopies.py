"""Near copies by shingle similarity: MinHash bands choose pairs, exact shingle sets decide.

Two texts are linked if their sets of distinct five-word shingles (as op4 reads
words; a shorter text is one shingle) have a Jaccard similarity of 0.8 or more,
and groups are the components of the links. Texts of equal words are one node,
keyed by a 64-bit hash. Each node enters 32 cells, one per band of five MinHash
values; a pair at similarity 0.8 misses all of them with probability 3e-6, at
0.9 with 1e-12.

First each node is compared with one other alone, the most central node of its
cells (whose own cells hold most nodes): this joins most copies of one text.
Such pairs are screened by the low bytes of all 160 MinHash values (at
similarity 0.8 a pair falls short of 104 equal ones with probability 2e-6) and
decided by the 64-bit hashes of both shingle sets.

Then only cells with nodes of different components count, one of several cells
with the same nodes. A cell may hold a large group, so its nodes are dealt into
blocks of bounded size: those of its largest component and the others apart. A
task holds two blocks with their shingle sets and compares every pair that isn't
of one component, may be similar by size and shares no cell of an earlier band;
only links that join components leave the task, fewer than it has nodes. So no
pair is left out, and no pair is a row.

Defined results: a null text counts as empty; texts without words are copies of
each other. Rows with a null id stay and name no group. Repeated rows are one
text, and all rows that repeat a kept id and text stay. A very long text is a
block of its own. An empty table gives an empty table. Extra columns pass
through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import LOWER, by_key, map_text, materialize, release, small_batches, splittable, utf8
from .components import components
from .simhash import SEED, shingle_hashes

SHINGLE = 5
BANDS, ROWS = 32, 5
EQUAL = 104
BLOCK_NODES, BLOCK_SHINGLES = 2048, 1 << 20
"""A block of a cell has about as many nodes, or distinct shingles of 8 bytes, at most."""
MASKS, FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
FACTORS = FACTORS | np.uint64(1)


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def words_key(text: bytes) -> int:
    """Signed 64-bit hash of the words."""
    return int(np.uint64(xxh64_intdigest(b" ".join(text.translate(LOWER).split()), SEED)).view(np.int64))


def minhash(hashes: np.ndarray) -> np.ndarray:
    """The least of each of 160 mixed versions of a shingle set that isn't empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        mixed = (hashes[at : at + 1024, None] ^ MASKS) * FACTORS
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=least)
    return least


def cells(least: np.ndarray) -> np.ndarray:
    """One cell per band of MinHash values."""
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxh64_intdigest(bands[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 0.8 or more."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 9 * both >= 4 * (len(x) + len(y))


def with_key(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_key): ids can repeat with different texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp, n, cells, sig) for every row: hash of the words, number of shingles, a cell per band, low bytes."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column(1))
        sets = [shingle_set(t) for t in texts]
        least = [minhash(s) if len(s) else np.zeros(0, np.uint64) for s in sets]
        own = [cells(x).tolist() if len(x) else [] for x in least]
        return pa.record_batch(
            [
                batch.column(0), batch.column(2), pa.array([words_key(t) for t in texts], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()), pa.array(own, pa.list_(pa.int64())),
                pa.array([x.astype(np.uint8).tobytes() for x in least], pa.binary()),
            ],
            ["doc_id", "text_key", "fp", "n", "cells", "sig"],
        )

    return map_text(with_key(docs), step, "doc_id long, text_key long, fp long, n long, cells array<long>, sig binary")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(fp, hashes): the shingle sets of the texts with these ids, one row per fp."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column(0))
        return pa.record_batch(
            [pa.array([words_key(t) for t in texts], pa.int64()), pa.array([shingle_set(t).tobytes() for t in texts], pa.binary())],
            ["fp", "hashes"],
        )

    plain = with_key(docs)
    chosen = plain.join(ids, plain.doc_id.eqNullSafe(ids.first_id), "left_semi").select("text")
    return map_text(chosen, step, "fp long, hashes binary").dropDuplicates(["fp"])


def with_both(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Pairs (a, b) with the value of either: a, b, x, y."""
    x = values.select(F.col("fp").alias("a"), F.col(name).alias("x"))
    y = values.select(F.col("fp").alias("b"), F.col(name).alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")


def screened(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) that have enough MinHash values alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for k in (2, 3))
            good = pa.array((x == y).sum(axis=1) >= EQUAL)
            yield pa.record_batch([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])

    return with_both(pairs.distinct(), nodes, "sig").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are alike."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, x, y = (batch.column(k) for k in range(4))
        x, y = ([np.frombuffer(v, np.uint64) for v in c.to_pylist()] for c in (x, y))
        good = pa.array([alike(v, w) for v, w in zip(x, y)], pa.bool_())
        return pa.record_batch([a.filter(good), b.filter(good)], ["a", "b"])

    return map_text(with_both(pairs, sets, "hashes"), step, "a long, b long", "x")


def fitting(rows: DataFrame) -> DataFrame:
    """(a, b) of different components whose set sizes allow similarity 0.8."""
    fits = (F.least("n", "b_n") * 5 >= F.greatest("n", "b_n") * 4) & (F.col("root") != F.col("b_root"))
    return rows.where(fits).select(F.greatest("fp", "b_fp").alias("a"), F.least("fp", "b_fp").alias("b"))


def centres(crowded: DataFrame) -> DataFrame:
    """(cell, band, fp, n) rows with ``central``: how many nodes the cells of the node hold together."""
    sizes = crowded.groupBy("cell").agg(F.count("*").alias("size"))
    known = crowded.join(splittable(sizes, "cell"), "cell").groupBy("fp").agg(F.sum("size").alias("central"))
    return crowded.join(splittable(known, "fp"), "fp").select("cell", "band", "fp", "n", "central")


def first_pairs(rows: DataFrame) -> DataFrame:
    """Each node with the most central other node of its cells."""
    tops = rows.groupBy("cell").agg(F.max(F.struct("central", "fp", "n")).alias("top"))
    sides = rows.join(splittable(tops, "cell"), "cell").where("top.fp <> fp")
    best = sides.groupBy("fp", "n").agg(F.max("top").alias("top"))
    return fitting(best.select("fp", "n", F.col("fp").alias("root"), F.col("top.fp").alias("b_fp"), F.col("top.n").alias("b_n"), F.col("top.fp").alias("b_root")))


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    named = splittable(roots.select(F.col("node").alias("fp"), "root"), "fp")
    return materialize(rows.join(named, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "open")


def open_cells(rows: DataFrame) -> DataFrame:
    """(cell, main, others, mains): the cells of several components, without those that hold the nodes of an earlier band's.

    ``main`` is the largest component; ``others`` and ``mains`` are numbers of blocks, ``mains`` zero where one block holds all.
    """
    counts = rows.groupBy("cell", "band", "root").agg(
        F.count("*").alias("own"), F.sum("n").alias("weight"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y")
    )
    every = counts.groupBy("cell", "band").agg(
        F.sum("own").alias("size"), F.sum("weight").alias("total"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max(F.struct("own", "root", "weight")).alias("main")
    )
    once = every.where("size > main.own").groupBy("size", "total", "x", "y").agg(F.min(F.struct("band", "cell", "main")).alias("first"))

    def blocks(nodes: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(nodes / BLOCK_NODES), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")

    main = F.col("first.main")
    apart = blocks(F.col("size"), F.col("total")) > 1
    return once.select(
        F.col("first.cell").alias("cell"), main.root.alias("main"),
        F.when(apart, blocks(F.col("size") - main.own, F.col("total") - main.weight)).otherwise(1).alias("others"),
        F.when(apart, blocks(main.own, main.weight)).otherwise(0).alias("mains"),
    )


def dealt(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(cell, band, i, j, first, fp, root): every node of the cells for each pair i <= j of blocks that it is compared in."""
    other = (F.col("mains") == 0) | (F.col("root") != F.col("main"))
    at = F.pmod(F.xxhash64("fp", "cell"), F.when(other, F.col("others")).otherwise(F.col("mains"))).cast("int")
    placed = rows.join(splittable(found, "cell"), "cell").withColumn("at", F.when(other, at).otherwise(F.col("others") + at))
    last = F.when(other, F.col("others") + F.col("mains")).otherwise(F.col("others")) - 1
    pairs = placed.withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    return pairs.select(
        "cell", "band", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"), (F.col("at") <= F.col("with")).alias("first"), "fp", "root"
    )


def joining(fp: np.ndarray, root: np.ndarray, cells: np.ndarray, band: int, own: int, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between alike nodes that join components: the first ``own`` nodes against the rest, or among each other if they are all."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    start = np.cumsum(n) - n
    numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
    group = np.unique(root, return_inverse=True)[1]
    mine = np.zeros(len(numbers), np.int32)
    out = []
    for x in range(own):
        low = x + 1 if own == len(fp) else own
        may = (group[low:] != group[x]) & (5 * np.minimum(n[low:], n[x]) >= 4 * np.maximum(n[low:], n[x]))
        may &= ~(cells[low:, :band] == cells[x, :band]).any(axis=1)
        near = low + np.flatnonzero(may)
        if not len(near):
            continue
        size = n[near]
        first = np.cumsum(size) - size
        at = np.repeat(start[near] - first, size) + np.arange(int(size.sum()))
        words = numbers[start[x] : start[x] + n[x]]
        mine[words] = 1
        both = np.add.reduceat(mine[numbers[at]], first)
        mine[words] = 0
        for y in near[9 * both >= 4 * (size + n[x])].tolist():
            if group[y] != group[x]:
                group[group == group[y]] = group[x]
                out.append((max(int(fp[x]), int(fp[y])), min(int(fp[x]), int(fp[y]))))
    return out


def links_within(pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links of ``joining`` for every two blocks of a cell, each with its nodes' sets in one task."""
    known = nodes.select("fp", "cells").join(sets, "fp")
    small_batches(pairs.sparkSession)

    def judged(batch: pa.RecordBatch) -> list[tuple[int, int]]:
        fp, root = (batch.column(k).to_numpy() for k in ("fp", "root"))
        cells = batch.column("cells").flatten().to_numpy().reshape(-1, BANDS)
        hashes = [np.frombuffer(h, np.uint64) for h in batch.column("hashes").to_pylist()]
        return joining(fp, root, cells, batch.column("band")[0].as_py(), batch.column("first").true_count, hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        for batch in batches:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key = np.stack([rows.column(k).to_numpy() for k in ("cell", "i", "j")])
            edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
            for a, b in zip(edges, edges[1:]):
                out += judged(rows.slice(a, b - a))
            held = rows.slice(edges[-1])
            if out:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])
                out = []
        out = judged(held) if held is not None else []
        if out:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])

    key = ["cell", "i", "j"]
    ordered = pairs.join(known, "fp").repartition(*key).sortWithinPartitions(*key, F.desc("first"))
    return ordered.mapInArrow(run, "a long, b long")


def links(crowded: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root) of the nodes with links; ``crowded`` has (cell, band, fp, n)."""
    plain = materialize(centres(crowded), "placed")
    found = materialize(verified(screened(first_pairs(plain), nodes), sets), "links")
    roots = components(found)
    release(found)
    rows = rooted(plain, roots)
    release(plain)
    cells_left = materialize(open_cells(rows), "cells")
    found = materialize(links_within(dealt(rows, cells_left), nodes, sets), "links")
    release(rows, cells_left)
    if not found.isEmpty():
        roots = components(found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    release(found)
    return roots


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the least id, in the columns of the input.

    Rows that repeat the least id with a text of the group all stay; rows with a null id stay too.
    """
    signed = materialize(signatures(docs), "signatures")
    distinct = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    placed = signed.select(F.posexplode("cells").alias("band", "cell"), "fp", "n")
    shared = placed.groupBy("cell").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
    crowded = materialize(placed.join(splittable(shared.select("cell"), "cell"), "cell").distinct(), "crowded")
    near = crowded.select("fp").distinct()
    nodes = materialize(signed.join(splittable(near, "fp"), "fp").groupBy("fp").agg(F.min("sig").alias("sig"), F.min("cells").alias("cells")), "nodes")
    ids = distinct.join(near, "fp").select("first_id").distinct()
    sets = materialize(sets_of(docs, ids), "sets")
    roots = links(crowded, nodes, sets)
    release(crowded, nodes, sets)
    grouped = distinct.join(by_key(roots), distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first_id").alias("least_id"))
    lookup = splittable(grouped.join(by_key(splittable(least, "root")), "root").select("fp", "least_id"), "fp")
    gone = signed.join(by_key(lookup), "fp").where("least_id < doc_id").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    key = F.xxhash64(F.coalesce(docs.text.cast("string"), F.lit("")))
    return docs.join(by_key(gone), (docs.doc_id.cast("long") == gone.gone_id) & (key == gone.gone_key), "left_anti")
