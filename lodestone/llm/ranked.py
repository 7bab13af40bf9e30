"""Ranked lexical search over a two-level quantised index.

Spark cuts documents into blocks and indexes each block by itself, so no posting
is ever shuffled by its term and no term is hot. A block is one row: document ids
and lengths, its terms, and per term the documents with their counts (exact
level). When it is searched its postings get the first level: a term's part of a
score, at most 1,000,000, as a byte of ``STEP`` steps, rounded up. Bytes times
weights, summed over an item's terms, bound every document's score from above;
one step less per term bounds it from below. The k-th best lower bound, or the
k-th best score of blocks before, is the floor: every document whose upper bound
reaches it is scored again in exact integers, and no other can be among the k.

What all documents decide (their number, their terms, document frequencies) is
aggregated from the blocks' own counts. Items with their weights are packed into
blocks too. Blocks of documents are dealt into shards by postings; a task holds a
shard and the items stream past, so a document block is sent once and the items
once a shard. A shard returns k rows an item at most.

Defined results: a null text holds no term. Documents or items with a null id
take no part; repeated document ids are documents of their own, ranked one after
the other; of a repeated item id the least text asks. An item without terms, or
whose terms occur nowhere, has no rows; so has an empty table. Long texts are
indexed whole; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_ONLY, materialize, pieces, release, small_batches, utf8

K = 20
STEP = 3922
"""255 steps reach beyond 1,000,000, the most that a term's part can be."""
BLOCK_BYTES = 8 << 20
FILE_BLOCKS = 4
"""Blocks of a file: Spark writes and reads all rows of a file's part at once, some 10 MB each."""
SHARD_POSTINGS = 1 << 22
ITEM_TERMS = 1 << 15
BLOCK = "ids binary, lengths binary, terms array<binary>, ends binary, docs binary, counts binary, found array<int>, n_docs long, n_terms long, n_postings long"


def tokens(text: bytes) -> list[bytes]:
    return text.translate(WORD_ONLY).split()


def build_index(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of documents: postings by term, and the block's part of the corpus counts."""

    def block(part: pa.RecordBatch) -> pa.RecordBatch | None:
        number: dict[bytes, int] = {}
        ids, lengths, held_terms, held_counts, sizes = [], [], [], [], []
        for doc_id, text in zip(part.column(0).to_pylist(), utf8(part.column(1))):
            words = tokens(text)
            if not words:
                continue
            own = Counter(words)
            ids.append(doc_id)
            lengths.append(len(words))
            sizes.append(len(own))
            held_terms.extend([number.setdefault(w, len(number)) for w in own])
            held_counts.extend(own.values())
        if not ids:
            return None
        terms = np.array(held_terms, np.int32)
        order = np.argsort(terms, kind="stable")
        docs_of = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[order]
        found = np.bincount(terms, minlength=len(number))
        row = {
            "ids": np.array(ids, np.int64).tobytes(), "lengths": np.array(lengths, np.int64).tobytes(), "terms": list(number), "ends": np.cumsum(found).tobytes(),
            "docs": docs_of.tobytes(), "counts": np.array(held_counts, np.int32)[order].tobytes(), "found": found.tolist(),
            "n_docs": len(ids), "n_terms": sum(lengths), "n_postings": len(terms),
        }
        kinds = [pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array([row[c]], k) for c, k in zip(row, kinds)], list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in pieces(batch, "text", block_bytes):
                own = part.column(1).nbytes
                if held and size + own > block_bytes:
                    out = block(joined(held))
                    held, size = [], 0
                    if out is not None:
                        yield out
                held.append(part)
                size += own
        if held and (out := block(joined(held))) is not None:
            yield out

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    small_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).mapInArrow(run, BLOCK)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times): the terms of every item with their repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                bags = [Counter(tokens(t)) for t in utf8(part.column(1))]
                yield pa.record_batch(
                    [part.column(0).take(pa.array(np.repeat(np.arange(len(bags)), [len(b) for b in bags]))), pa.array([t for b in bags for t in b], pa.binary()),
                     pa.array([n for b in bags for n in b.values()], pa.int64())],
                    ["item_id", "term", "times"],
                )

    one = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min(F.col("text").cast("string")).alias("text"))
    return one.mapInArrow(run, f"item_id {items.schema['item_id'].dataType.simpleString()}, term binary, times long")


def weighted(index: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """(item_id, term, weight) of the terms that some document holds; the weight has the repeats in it."""
    held = index.select(F.explode(F.arrays_zip("terms", "found")).alias("e")).select(F.col("e.terms").alias("term"), F.col("e.found").alias("found"))
    wanted = held.join(asked.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.sum("found").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    return asked.join(df, "term").select("item_id", "term", (F.col("times") * weight).alias("weight"))


def item_blocks(weights: DataFrame, block_terms: int = ITEM_TERMS) -> DataFrame:
    """(items, sizes, terms, weights): items of about ``block_terms`` terms together."""
    bags = weights.groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("bag"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> pa.RecordBatch:
            items = pa.concat_arrays([b.column(0) for b in held])
            bags = pa.concat_arrays([b.column(1) for b in held])
            flat = bags.flatten()
            sizes = np.diff(bags.offsets.to_numpy()).astype(np.int32)

            def listed(a: pa.Array) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)

            return pa.record_batch([listed(items), listed(pa.array(sizes)), listed(flat.field("term")), listed(flat.field("weight"))], ["items", "sizes", "terms", "weights"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                held.append(row)
                size += len(row.column(1)[0])
                if size >= block_terms:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    kind = weights.schema["item_id"].dataType.simpleString()
    return bags.mapInArrow(run, f"items array<{kind}>, sizes array<int>, terms array<binary>, weights array<long>")


class Block:
    """The postings of a block of documents with their first level; ``row`` has buffers, and the terms as they came."""

    def __init__(self, row: dict, n: int, total: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.terms: pa.BinaryArray = row["terms"]
        self.number: dict[bytes, int] = {}
        self.ends = np.frombuffer(row["ends"], np.int64)
        self.docs = np.frombuffer(row["docs"], np.int32)
        self.counts = np.frombuffer(row["counts"], np.int32)
        lengths = np.frombuffer(row["lengths"], np.int64)
        self.norm = 12 * (75 + (25 * lengths * n) // total)
        self.bytes = (-(-self.part(self.counts, self.docs) // STEP)).astype(np.uint8)

    def meet(self, asked: pa.BinaryArray) -> None:
        """Number the terms that are asked next: a block has far more of its own."""
        at = pa.compute.index_in(asked, value_set=self.terms)
        there = at.is_valid()
        self.number = dict(zip(asked.filter(there).to_pylist(), at.filter(there).to_pylist()))

    def part(self, counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
        tf = counts.astype(np.int64)
        return (1_000_000_000 * tf) // (1000 * tf + self.norm[docs])

    def best(self, terms: list[bytes], weights: list[int], floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best documents with a score of ``floor`` or more."""
        upper, seen = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)
        spans = []
        for term, weight in zip(terms, weights):
            t = self.number.get(term)
            if t is None or not weight:
                continue
            a, b = (int(self.ends[t - 1]) if t else 0), int(self.ends[t])
            own = self.docs[a:b]
            upper[own] += self.bytes[a:b] * np.int64(weight)
            seen[own] += weight
            spans.append((a, b, weight))
        upper *= STEP
        lower = upper - (STEP - 1) * seen
        if len(lower) > k:
            floor = max(floor, int(np.partition(lower, len(lower) - k)[len(lower) - k]))
        near = np.flatnonzero(upper >= max(floor, 1))
        scores = np.zeros(len(near), np.int64)
        if len(near):
            for a, b, weight in spans:
                own = self.docs[a:b]
                at = np.minimum(np.searchsorted(own, near), len(own) - 1)
                hit = np.flatnonzero(own[at] == near)
                scores[hit] += weight * self.part(self.counts[a:b][at[hit]], near[hit])
        good = scores > 0
        return top(scores[good], self.ids[near[good]], k)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, from an index built for the call."""
    index = materialize(build_index(docs, block_bytes), "blocks", maxRecordsPerFile=str(FILE_BLOCKS))
    out = materialize(search_index(index, items, k, shard_postings), "ranked")
    release(index)
    return out


def search_index(index: DataFrame, items: DataFrame, k: int = K, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score) over a table of ``build_index``."""
    small_batches(index.sparkSession)
    whole = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("total"), F.sum("n_postings").alias("postings"), F.count("*").alias("blocks")).first()
    n, total = whole["n"] or 0, whole["total"] or 1
    kind = items.schema["item_id"].dataType.simpleString()
    shards = max(1, -(-(whole["postings"] or 0) // shard_postings), min(24, n // 2048))
    blocks = item_blocks(weighted(index, item_terms(items), n))
    asks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # blocks are numbered as they are read, so that shards have as many, give or take one a task
    each = -(-whole["blocks"] // max(1, index.rdd.getNumPartitions()))
    number = F.spark_partition_id() * each + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    place = F.pmod(number, F.lit(shards)).cast("int")
    held = index.select("ids", "lengths", "terms", "ends", "docs", "counts").withColumn("shard", place)
    both = held.unionByName(asks, allowMissingColumns=True).withColumn("is_item", F.col("ids").isNull())
    dealt = both.repartitionById(shards, "shard").sortWithinPartitions("shard", "is_item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, blocks = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("shard", "is_item")}
                if row["shard"] != shard:
                    shard, blocks = row["shard"], []
                if not row["is_item"]:
                    buffers = {c: batch.column(c)[i].as_buffer() for c in ("ids", "lengths", "ends", "docs", "counts")}
                    blocks.append(Block(buffers | {"terms": batch.column("terms")[i].values}, n, total))
                    continue
                if not blocks:
                    continue
                own = {c: batch.column(c)[i].as_py() for c in ("items", "sizes", "terms", "weights")}
                asked = batch.column("terms")[i].values.unique()
                for block in blocks:
                    block.meet(asked)
                out_items, out_ids, out_scores, at = [], [], [], 0
                for item, size in zip(own["items"], own["sizes"]):
                    terms, weights = own["terms"][at : at + size], own["weights"][at : at + size]
                    at += size
                    scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
                    for block in blocks:
                        floor = int(scores[-1]) if len(scores) == k else 1
                        new, new_ids = block.best(terms, weights, floor, k)
                        scores, ids = top(np.concatenate([scores, new]), np.concatenate([ids, new_ids]), k)
                    out_items += [item] * len(ids)
                    out_ids.append(ids)
                    out_scores.append(scores)
                if out_items:
                    yield pa.record_batch(
                        [pa.array(out_items, batch.schema.field("items").type.value_type), pa.array(np.concatenate(out_ids)), pa.array(np.concatenate(out_scores))],
                        ["item_id", "doc_id", "score"],
                    )

    columns = ["ids", "lengths", "terms", "ends", "docs", "counts", "items", "sizes", "weights", "shard", "is_item"]
    found = dealt.select(*columns).mapInArrow(run, f"item_id {kind}, doc_id long, score long")
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item; shards' rows are cut down in parts before they meet."""
    entry = F.struct((-F.col("score")).alias("s"), F.col("doc_id").alias("i"))
    parts = found.groupBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(16)).alias("part")).agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k).alias("top"))
    merged = parts.groupBy("item_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    return merged.select("item_id", F.posexplode("top").alias("pos", "e")).select(
        "item_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.i").alias("doc_id"), (-F.col("e.s")).alias("score")
    )
