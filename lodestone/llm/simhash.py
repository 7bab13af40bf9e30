"""SimHash near-duplicates: segment popcounts, a grid join, an exact check.

A 64-bit fingerprint is cut into 16 segments of four bits; the counts of set
bits per segment embed it in a grid. One differing bit moves a point by one
step, so fingerprints at Hamming distance 2 or less have points at Manhattan
distance 2 or less, and some cell lies within one step of both. Each distinct
fingerprint enters its own cell and the cells one step away (33 at most); only
cells with two fingerprints or more go on.

The exact check stays linear in the size of a cell. In such a cell a
fingerprint enters the values with that cell's counts which differ from it in at
most one bit (four at most). Two fingerprints differ in at most two bits if and
only if they share such a value, and all that share one are linked, so a star to
the least of them has the links of all pairs. Components follow from the stars.

Defined results: a null text counts as empty; a text without words has
fingerprint zero. Rows with a null id get a fingerprint and the component of
their fingerprint's group, but name no component (null if no id is there).
Repeated rows each give a row, and equal texts one component. Very long texts
are hashed whole, in slices of rows of bounded size, one row at least. An empty
table gives an empty table. Extra columns are ignored by ``near_duplicates`` and
pass through ``keep_first``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import LOWER, by_key, map_text, materialize, splittable, utf8
from .components import components

SHINGLE = 3
SEED = 42
SEGMENTS = 16
WIDTH = 64 // SEGMENTS
BIT_TABLE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
LANES = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    ends = (starts + lengths)[size - 1 :].tolist()
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends)], np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Bits that are set in over half of the shingle hashes, as a signed 64-bit number."""
    hashes = shingle_hashes(text, size)
    if not len(hashes):
        return 0
    lanes = hashes.view(np.uint8).reshape(-1, 8) + LANES
    counts = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ BIT_TABLE
    bits = (counts.ravel() * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp) for every row: ids can repeat with different texts."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([fingerprint(t, size) for t in utf8(batch.column(1))], pa.int64())
        return pa.record_batch([batch.column(0), batch.column(2), found], ["doc_id", "text_key", "fp"])

    text = F.col("text").cast("string")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("text_key"))
    return map_text(plain, step, "doc_id long, text_key long, fp long")


def segment_counts(values: np.ndarray) -> np.ndarray:
    """(values x segments) numbers of set bits."""
    nibbles = (values[:, None] >> (np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(WIDTH))) & np.uint64(15)
    return np.bitwise_count(nibbles).astype(np.int64)


STEPS = np.int64(8) ** np.arange(SEGMENTS, dtype=np.int64)


def cells(prints: DataFrame) -> DataFrame:
    """(cell, fp): the own cell of each fingerprint and those one step away."""

    def run(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 4096):
                part = values[at : at + 4096]
                counts = segment_counts(part.view(np.uint64))
                own = counts @ STEPS
                up, down = counts < WIDTH, counts > 0
                all_cells = np.concatenate([own[:, None], own[:, None] + STEPS, own[:, None] - STEPS], axis=1)
                good = np.concatenate([np.ones((len(part), 1), bool), up, down], axis=1)
                yield pa.record_batch(
                    [pa.array(all_cells[good]), pa.array(np.repeat(part, good.sum(axis=1)))], ["cell", "fp"]
                )

    return prints.select("fp").mapInArrow(run, "cell long, fp long")


def neighbours(crowded: DataFrame) -> DataFrame:
    """(value, fp): for each (cell, fp) the values of that cell within one bit of the fingerprint."""

    def run(batches):
        for batch in batches:
            cell = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False)
            moved = cell - segment_counts(fp.view(np.uint64)) @ STEPS
            out_value, out_fp = [fp[moved == 0]], [fp[moved == 0]]
            for k in range(SEGMENTS):
                for sign in (1, -1):
                    own = fp[moved == sign * STEPS[k]].view(np.uint64)
                    for bit in range(k * WIDTH, (k + 1) * WIDTH):
                        mask = np.uint64(1 << bit)
                        hit = own[((own & mask) == 0) == (sign == 1)]
                        out_value.append((hit ^ mask).view(np.int64))
                        out_fp.append(hit.view(np.int64))
            yield pa.record_batch([pa.array(np.concatenate(out_value)), pa.array(np.concatenate(out_fp))], ["value", "fp"])

    return crowded.select("cell", "fp").mapInArrow(run, "value long, fp long")


def shared(rows: DataFrame, key: str) -> DataFrame:
    """Keys with two fingerprints or more, with the least of them."""
    ends = rows.groupBy(key).agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
    return splittable(ends.where("low <> high").select(key, "low"), key)


def links(prints: DataFrame) -> DataFrame:
    """Star edges (a, b) that join all distinct fingerprints at distance 2 or less."""
    placed = cells(prints)
    near = neighbours(placed.join(shared(placed, "cell").select("cell"), "cell"))
    exact = F.bit_count(F.col("fp").bitwiseXOR(F.col("low"))).between(1, 2)
    return near.join(shared(near, "value"), "value").where(exact).select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def members(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, text_key, fp, component_id."""
    own = materialize(fingerprints(docs, size), "fingerprints")
    distinct = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(distinct))
    grouped = distinct.join(by_key(roots), distinct.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    lookup = grouped.join(by_key(splittable(least, "root")), "root").select("fp", "component_id")
    return own.join(by_key(lookup), "fp").select("doc_id", "text_key", "fp", "component_id")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint as 16 hex digits, component_id."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return members(docs, size).select("doc_id", hexed, "component_id")


def keep_first(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One document of each group, the one with the least id, in the columns of the input.

    Rows that repeat the least id all stay; rows with a null id stay too. Of rows with one id and several texts only
    those go whose text is a copy.
    """
    found = members(docs, size).where("component_id < doc_id")
    gone = found.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    return docs.join(by_key(gone), (docs.doc_id.cast("long") == gone.gone_id) & (text_key(docs.text.cast("string")) == gone.gone_key), "left_anti")
