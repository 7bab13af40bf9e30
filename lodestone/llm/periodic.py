"""Periodic runs of words: Lyndon arrays by matched extensions, after Ellert and Fischer.

The words of a text are numbered in order of first appearance, which is all the
alphabet that is needed: the method only compares letters. One pass from left to
right keeps the starts of suffixes that increase on a stack. A new suffix is
compared with the top; it takes it off where it is smaller, which gives the
longest Lyndon word that begins there, and else lies above it. The length of
each comparison is kept with its pair, and no letter is matched twice:

* the match that reaches furthest right says that what follows is a copy of
  earlier letters, so pairs within it have the length of the earlier pair, unless
  that reaches the end of the match, from where it is then carried on;
* below a suffix that was taken off, lengths with that suffix are known for both
  sides: where they differ the smaller is the answer, where they are equal it is
  carried on from there.

So a pass takes linear time, without suffix structures and without fingerprints.
Every run is a repetition of a Lyndon word of one of two orders, the numbers' and
its reverse, that is the longest at its start; where such a word repeats, the
matched length gives the run's end, and one scan of less than a period its start.

Words that can't lie in a run of the asked kind are cut out first, exactly: where
a run has three periods or more, each pair of neighbouring words in it occurs
twice at least in the text. The pass runs over the stretches between.

``periodic_runs`` returns one row per row. Defined results: a null text counts as
empty, without runs; equal runs of several roots are one; texts of any length
are read whole, in memory in proportion to one text; rows with a null or
repeated id are rows like any other; an empty table gives none; other columns are
ignored. ``min_exponent`` is 3 at least (the cut relies on it).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text, utf8

MIN_LENGTH = 24
MIN_EXPONENT = 3
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def lyndon_edges(x: list[int]) -> list[tuple[int, int, int]]:
    """(start, next, matched) for each longest Lyndon word x[start:next] that another suffix follows.

    ``matched`` is the number of letters that the suffixes at both ends share.
    """
    n = len(x)
    x = [*x, -1]
    follower, matched = [n] * n, [0] * n  # the next smaller suffix, and the letters shared with it
    before, shared = [-1] * n, [0] * n  # the last smaller suffix, and the letters shared with it
    edges, stack = [], []
    end = right = shift = 0  # x[right:end] is a copy of what lies ``shift`` before
    for j in range(n):
        last = known = -1  # the suffix taken off last, and what it shares with j
        while stack:
            i = stack[-1]
            lower = None
            if last >= 0 and right == j:
                length = known
                if shared[last] != known:
                    lower, length = shared[last] > known, min(shared[last], known)
            elif j < end:
                a, b = i - shift, j - shift
                taken = follower[a] == b
                length = matched[a] if taken else shared[b]
                if length < end - j:
                    lower = taken
                else:
                    length = end - j
            else:
                length = 0
            if lower is None:
                at = j + length
                back = i + length
                while at < n and x[at] == x[back]:
                    at += 1
                    back += 1
                lower = x[at] < x[back]
                length = at - j
                if at >= end:
                    end, right, shift = at, j, j - i
            if not lower:
                before[j], shared[j] = i, length
                break
            stack.pop()
            follower[i], matched[i] = j, length
            edges.append((i, j, length))
            last, known = i, length
        stack.append(j)
    return edges


def runs_of(x: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs with at least that length and exponent."""
    first: dict[tuple[int, int], int] = {}
    top = max(x, default=0)
    for order in (x, [top - v for v in x]):
        for i, j, length in lyndon_edges(order):
            # a run's first Lyndon word begins within its first period
            if length > (min_exponent - 2) * (j - i):
                key = (j + length, j - i)
                if i < first.get(key, len(x)):
                    first[key] = i
    out = set()
    for (end, period), start in first.items():
        while start and x[start - 1] == x[start - 1 + period]:
            start -= 1
        if end - start >= max(min_length, min_exponent * period):
            out.add((start, end - start, period))
    return out


def stretches(codes: np.ndarray, min_length: int) -> list[tuple[int, int]]:
    """[start, stop) of the parts in which each pair of neighbours occurs twice or more in the text."""
    pairs = codes[:-1].astype(np.int64) * (int(codes.max()) + 1) + codes[1:]
    order = np.argsort(pairs, kind="stable")
    same = pairs[order[1:]] == pairs[order[:-1]]
    often = np.zeros(len(pairs) + 2, bool)  # a false at either end
    often[order[1:][same] + 1] = True
    often[order[:-1][same] + 1] = True
    edges = np.flatnonzero(often[1:] != often[:-1]).reshape(-1, 2)
    return [(a, b + 1) for a, b in edges.tolist() if b + 1 - a >= min_length]


def find_runs(words: list, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words, by start and then period."""
    if len(words) < max(2, min_length):
        return []
    number: dict = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
    found = [
        (a + start, length, period)
        for a, b in stretches(codes, min_length)
        for start, length, period in runs_of(codes[a:b].tolist(), min_length, min_exponent)
    ]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def periodic_runs(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
    change: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """(doc_id, runs, collapsed): the runs of every text's words, and the text without their repetitions.

    ``change`` may replace the words of a document before they are searched.
    """
    if min_exponent < 3:
        raise ValueError("min_exponent must be 3 or more")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, kept = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            words = text.split()
            if change is not None:
                words = change(doc_id, words)
            runs = find_runs(words, min_length, min_exponent)
            found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
            kept.append(b" ".join(collapsed(words, runs)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return pa.record_batch([batch.column(0), pa.array(found, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_text(plain, step, f"doc_id long, runs array<{RUN}>, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the repetition that the query's contract puts into a tenth of the documents."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or not n or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def strongest(runs: Column) -> Column:
    """The run with the greatest exponent, compared exactly; the first among equals; null if there is none."""

    def better(a: Column, b: Column) -> Column:
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def run_report(docs: DataFrame) -> DataFrame:
    """One row per document: its runs counted, the strongest, and digests of the runs and of the collapsed text."""
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    rows = periodic_runs(docs, change=planted).withColumn("best", strongest(F.col("runs")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(listed, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
