"""Exact top-k by inner product: columnar branch and bound.

Candidates are packed into blocks in vertical layout (one row of numbers per
dimension); queries into blocks of their own. For a query, inner products are
accumulated one group of dimensions at a time. What the remaining dimensions can
add is at most the product of the remaining norms; candidates that cannot reach
the k-th best value known for the query drop out, and the survivors are
compacted before the next group. A task keeps the k best per query over all the
blocks it sees, so its bounds tighten as it goes.

Candidate blocks are dealt into shards of ``shard_numbers`` components. One
shuffle by shard brings each task the blocks of a shard, which it holds, and
after them the query blocks, which stream past: every candidate block is sent
once, every query block once per shard. So the stated query set meets all rows in
blocks, and nothing is broadcast.

Defined results: an empty table gives none, extra columns are ignored, vectors of
any length are handled in blocks of bounded size. Rows with a null id, or a vector that is null or holds null or
non-finite components, take no part. Vectors of another length than the query's
are no candidates. A repeated candidate row counts each time; a query's own id is
never its candidate, and of a repeated query id the row with the least vector
asks. Fewer than k candidates are all returned; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

SCALE = 1024
K = 10
GROUP = 8
BLOCK_NUMBERS = 1 << 18
QUERY_NUMBERS = 1 << 14
SHARD_NUMBERS = 1 << 22
PACKED = "dim int, ids binary, numbers binary"


def whole_numbers(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components as floor(scale * x), of the rows that take part."""
    v = F.col(vector).cast(T.ArrayType(T.DoubleType()))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~bad)
    return rows.select(F.col(key).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).cast("array<long>").alias("v"))


def packed(rows: DataFrame, block_numbers: int) -> DataFrame:
    """Blocks of vectors of one length: ids, and numbers in vertical layout (dimensions x rows)."""

    def block(parts: list, dim: int) -> pa.RecordBatch:
        ids = np.concatenate([a for a, _ in parts])
        numbers = np.concatenate([b for _, b in parts])
        return pa.record_batch(
            [pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(numbers.T).tobytes()], pa.binary())],
            ["dim", "ids", "numbers"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        count: dict[int, int] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            column = batch.column(1)
            sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                block_rows = max(1, block_numbers // max(dim, 1))
                own = np.flatnonzero(sizes == dim)
                values = flat[(ends[own] - dim)[:, None] + np.arange(dim)].reshape(len(own), dim)
                at = 0
                while at < len(own):
                    more = min(block_rows - count.get(dim, 0), len(own) - at)
                    held.setdefault(dim, []).append((ids[own[at : at + more]], values[at : at + more]))
                    at, count[dim] = at + more, count.get(dim, 0) + more
                    if count[dim] == block_rows:
                        yield block(held.pop(dim), dim)
                        count[dim] = 0
        for dim, parts in held.items():
            yield block(parts, dim)

    return rows.mapInArrow(run, PACKED)


def unpacked(dim: int, ids: bytes, numbers: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(numbers, np.int64).reshape(dim, len(own))


class Shard:
    """The candidates of one shard: blocks per vector length, small ones of several tasks put together."""

    def __init__(self, number: int, block_numbers: int):
        self.number, self.block_numbers = number, block_numbers
        self.loose: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.blocks: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def add(self, dim: int, ids: np.ndarray, numbers: np.ndarray) -> None:
        self.loose.setdefault(dim, []).append((ids, numbers))
        if sum(n.size for _, n in self.loose[dim]) >= self.block_numbers:
            self.close(dim)

    def close(self, dim: int) -> None:
        parts = self.loose.pop(dim, None)
        if parts:
            ids, numbers = np.concatenate([i for i, _ in parts]), np.concatenate([n for _, n in parts], axis=1)
            self.blocks.setdefault(dim, []).append((ids, numbers, tails(numbers)))

    def search(self, dim: int, ids: np.ndarray, numbers: np.ndarray, k: int) -> pa.RecordBatch:
        """The k best candidates of the shard for each query of a block."""
        self.close(dim)
        tail = tails(numbers)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for j, query_id in enumerate(ids.tolist()):
            scores, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for own, matrix, own_tail in self.blocks.get(dim, ()):
                floor = float(scores[-1]) if len(scores) == k else -np.inf
                new, new_ids = search_block(numbers[:, j], tail[:, j], query_id, own, matrix, own_tail, floor, k)
                if len(new):
                    scores, found = np.concatenate([scores, new]), np.concatenate([found, new_ids])
                    top = best(scores, found, k)
                    scores, found = scores[top], found[top]
            out.append((scores, found))
        query_ids = np.repeat(ids, [len(s) for s, _ in out])
        return pa.record_batch(
            [pa.array(query_ids), pa.array(np.concatenate([f for _, f in out])), pa.array(np.concatenate([s for s, _ in out]))],
            ["query_id", "vec_id", "score"],
        )


def tails(numbers: np.ndarray) -> np.ndarray:
    """(groups + 1, rows) norms of what remains from each group of dimensions on, rounded up."""
    squares = numbers.astype(np.float64) ** 2
    sums = [squares[at : at + GROUP].sum(axis=0) for at in range(0, len(numbers), GROUP)]
    out = np.zeros((len(sums) + 1, numbers.shape[1]))
    for g in range(len(sums) - 1, -1, -1):
        out[g] = out[g + 1] + sums[g]
    return np.sqrt(out) * (1 + 1e-9)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: high scores first, small ids first among equals."""
    if len(scores) > 4 * k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= limit)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search_block(query: np.ndarray, query_tail: np.ndarray, own_id: int, ids: np.ndarray, numbers: np.ndarray, tail: np.ndarray, floor: float, k: int):
    """(scores, ids) of at most k candidates of a block that reach ``floor``."""
    alive = np.flatnonzero(ids != own_id)
    partial = np.zeros(len(alive), np.int64)
    for g, at in enumerate(range(0, len(query), GROUP)):
        rows = numbers[at : at + GROUP] if len(alive) == len(ids) else numbers[at : at + GROUP, alive]
        partial = partial + query[at : at + GROUP] @ rows
        rest = tail[g + 1, alive] * query_tail[g + 1]
        if len(alive) > k:
            low = partial - rest
            floor = max(floor, np.partition(low, len(low) - k)[len(low) - k])
        keep = partial + rest >= floor
        if not keep.all():
            alive, partial = alive[keep], partial[keep]
        if not len(alive):
            break
    top = best(partial, ids[alive], k)
    return partial[top], ids[alive][top]


def top_k(df: DataFrame, is_query: str = "vec_id % 100 = 0", k: int = K, scale: int = SCALE, shard_numbers: int = SHARD_NUMBERS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that ``is_query`` holds for, against all others."""
    small_batches(df.sparkSession)
    rows = whole_numbers(df, scale=scale)
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("numbers")).first()
    shards = max(1, -(-size["numbers"] // shard_numbers), min(24, -(-size["n"] // 2048)))
    # small tables still spread over the cluster
    block_numbers = max(1 << 12, min(BLOCK_NUMBERS, -(-size["numbers"] // shards)))
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    candidates = packed(rows, block_numbers).withColumn("shard", F.pmod(F.xxhash64("ids", "numbers", F.spark_partition_id()), F.lit(shards)).cast("int"))
    queries = packed(asked, QUERY_NUMBERS).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = candidates.withColumn("asks", F.lit(False)).unionByName(queries.withColumn("asks", F.lit(True)))
    dealt = both.repartition(shards, "shard").sortWithinPartitions("shard", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Shard(-1, block_numbers)
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids, numbers, shard, asks = (batch.column(c)[i].as_py() for c in range(5))
                if shard != held.number:
                    held = Shard(shard, block_numbers)
                if asks:
                    yield held.search(dim, *unpacked(dim, ids, numbers), k)
                else:
                    held.add(dim, *unpacked(dim, ids, numbers))

    found = dealt.select("dim", "ids", "numbers", "shard", "asks").mapInArrow(run, "query_id long, vec_id long, score long")
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; what each task kept is cut down in aggregates before it meets in one place."""
    entry = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i"))
    lists = found.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(16)).alias("part")).agg(
        F.slice(F.sort_array(F.collect_list(entry)), 1, k).alias("top")
    )
    merged = lists.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    return merged.select("query_id", F.posexplode("top").alias("pos", "e")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.i").alias("vec_id"), (-F.col("e.s")).alias("score")
    )
