"""Substring deduplication over a compacted de Bruijn graph of word k-mers.

A window of ``k`` words is an edge of the graph. Each window belongs to its
minimizer, the word m-mer within it whose hash is least (the leftmost of
equals); windows in a row with the same minimizer make one stretch, a path of
the graph. Equal windows have equal minimizers, so the graph falls apart by
minimizer, and only stretches, not single edges, are shuffled:

1. Per minimizer hash: the least and largest document, and whether all its
   stretches look the same (by a second hash). A minimizer of one document is
   dropped.
2. A minimizer whose stretches all look the same is a nonbranching path: each
   stretch is joined to that of the least document, its source.
3. Where stretches differ (the path branches, or a passage ends inside it), the
   edges are joined one by one, by two hashes of their words: a window's source
   is the least document that has it.
4. Windows of a document that follow each other and whose sources do too share
   a node of ``k - 1`` words and are joined to one long span: (document, start,
   number of windows) with its source (document, start).
5. The words at both coordinates of each span are read from the texts and
   compared, in blocks of 64 words. Where any differ (the hashes collided), the
   windows of those minimizers are grouped by their words themselves instead.

So hashes only choose candidates, and every removed word was compared with its
source. Hot passages are combined before a shuffle or split by a skewed join.

Defined results: a null text has no words. Documents with fewer than ``k`` words
lose nothing. Rows with a null id are kept whole and are nobody's source. Rows
that repeat an id count as one document, whether their texts are equal or not:
none of them loses what only rows of that id have. Very long texts are handled a
slice of rows at a time, one row at least. An empty table gives an empty table.
Extra columns are ignored by ``kept_words`` and pass through ``remove``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_key, map_text, materialize, release, utf8

K = 13
M = 7
SLICE = 1 << 18
BLOCK = 64
PLACE = 64  # a place is start * PLACE + size; a stretch has at most k - m + 1 windows
FIELDS = ("start", "size", "src_doc", "src_digest", "src_start")
SPAN_TYPE = "array<struct<" + ", ".join(f"{f}: long" for f in FIELDS) + ">>"
PAIR_TYPE = "array<struct<start: long, size: long>>"
PAIRS = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))
PART = 62  # blocks whose bits share a long
CUTS = pa.list_(pa.struct([("low", pa.int64()), ("n", pa.int64()), ("words", pa.string()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("start", pa.int64())]))
CUT_TYPE = "array<struct<low: long, n: long, words: string, doc_id: long, digest: long, start: long>>"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
RANDOM = np.random.default_rng(20240611)
BYTE_CODES = RANDOM.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
WORD_BASES = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(int(base), have, 1 << 64))
        out[have : 2 * have] = out[: min(have, n - have)] * step
        have *= 2
    return out[:n]


class Powers:
    """Powers of the bases and of their inverses, grown as needed."""

    def __init__(self) -> None:
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def get(self, base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
        found = self.kept.get(int(base))
        if found is None or len(found[0]) < n:
            size = 1 << max(12, n.bit_length())
            found = self.kept[int(base)] = powers(base, size), powers(inverse(base), size)
        return found


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of many texts in one buffer: places, document index and hashes."""

    def __init__(self, texts: list[bytes], kinds: int = 1):
        joined = b" ".join(texts) + b" "
        self.raw = np.frombuffer(joined, np.uint8)
        space = SPACE[self.raw]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(self.raw) and not space[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[::2], edges[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.doc = np.searchsorted(self.text_starts, self.starts, side="right") - 1
        self.first_word = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.hashes = [self.word_hashes(k) for k in range(kinds)]

    def word_hashes(self, kind: int) -> np.ndarray:
        up, down = POWERS.get(BASES[kind], len(self.raw))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[kind][self.raw] * up[: len(self.raw)])])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])

    def spans(self, kind: int, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of runs of ``size`` words from ``start``."""
        up, down = POWERS.get(WORD_BASES[kind], len(self.starts) + 1)
        if not hasattr(self, "totals"):
            self.totals: dict[int, np.ndarray] = {}
        if kind not in self.totals:
            own = self.hashes[kind] * up[: len(self.starts)]
            self.totals[kind] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own)])
        total = self.totals[kind]
        return mix((total[start + size] - total[start]) * down[start])

    def joined(self, first: int, stop: int) -> str:
        """Words ``first`` to ``stop``, one space between them."""
        return b" ".join(self.raw[self.starts[first] : self.ends[stop - 1]].tobytes().split()).decode() if stop > first else ""

    def stretches(self, k: int = K, m: int = M) -> tuple[np.ndarray, ...]:
        """(document index, first window, number of windows, minimizer hash) of every stretch."""
        n = len(self.starts)
        none = np.zeros(0, np.int64)
        if n < k:
            return none, none, none, none.astype(np.uint64)
        grams = self.spans(0, np.arange(n - m + 1), m)
        windows = n - k + 1
        least, where = grams[:windows].copy(), np.arange(windows)
        for j in range(1, k - m + 1):
            other = grams[j : j + windows]
            less = other < least
            least[less] = other[less]
            where[less] = np.flatnonzero(less) + j
        good = self.doc[:windows] == self.doc[k - 1 :]
        new = np.concatenate([[True], (where[1:] != where[:-1]) | (good[1:] != good[:-1]) | (self.doc[1:windows] != self.doc[: windows - 1])])
        first = np.flatnonzero(new)
        count = np.diff(np.concatenate([first, [windows]]))
        keep = good[first]
        first, count = first[keep], count[keep]
        return self.doc[first], first, count, least[first]


def batch_of(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v) for v in columns.values()], list(columns))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def lists(batch: pa.RecordBatch, name: str, fields: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """A column of arrays of structs as (row of each element, field, field, ...); null is no element."""
    column = batch.column(name)
    sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten()
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return rows, *(values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields)


def offsets_within(sizes: np.ndarray) -> np.ndarray:
    """0 ... size-1 for each size in turn."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def stretch_rows(docs: DataFrame, k: int, m: int, places: bool) -> DataFrame:
    """(gram, doc_id, path hash) of every stretch, or its (gram, doc_id, digest, place); a place is start * 64 + size."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = numbers(batch, "doc_id")
        words = Words(utf8(batch.column("text")), 1 if places else 2)
        doc, first, count, gram = words.stretches(k, m)
        out = {"gram": signed(gram), "doc_id": ids[doc]}
        if places:
            out |= {"digest": numbers(batch, "digest")[doc], "place": (first - words.first_word[doc]) * PLACE + count}
        else:
            out |= {"path": signed(words.spans(1, first, count + k - 1))}
        return batch_of(out)

    schema = "gram long, doc_id long, " + ("digest long, place long" if places else "path long")
    return map_text(docs, step, schema, limit=SLICE)


def window_rows(joined: DataFrame, k: int, words_too: bool = False) -> DataFrame:
    """(h1, h2, doc_id, digest, start) of every window of ``places``; with their words instead of the hashes if asked."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column("text"))
        words = Words(texts, 0 if words_too else 2)
        column = batch.column("places")
        place = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        base = np.repeat(np.arange(len(texts)), pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))
        start, size = place // PLACE, place % PLACE
        each = np.repeat(np.arange(len(size)), size)
        local, row = start[each] + offsets_within(size), base[each]
        at = words.first_word[row] + local
        where = {"doc_id": numbers(batch, "doc_id")[row], "digest": numbers(batch, "digest")[row], "start": local}
        if words_too:
            return batch_of({"words": [words.joined(a, a + k) for a in at.tolist()]} | where)
        return batch_of({"h1": signed(words.spans(0, at, k)), "h2": signed(words.spans(1, at, k))} | where)

    schema = "doc_id long, digest long, start long"
    return map_text(joined, step, ("words string, " if words_too else "h1 long, h2 long, ") + schema, limit=SLICE)


def merged(found: DataFrame) -> DataFrame:
    """Windows in a row whose sources are in a row too, as one span of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, size, *source = lists(batch, "spans", FIELDS)
            order = np.lexsort((start, row))
            row, start, size = row[order], start[order], size[order]
            src, digest, at = (x[order] for x in source)
            new = np.ones(len(row), bool)
            same = (row[1:] == row[:-1]) & (src[1:] == src[:-1]) & (digest[1:] == digest[:-1])
            new[1:] = ~(same & (start[1:] == start[:-1] + size[:-1]) & (at[1:] == at[:-1] + size[:-1]))
            first = np.flatnonzero(new)
            total = np.add.reduceat(size, first) if len(first) else size
            values = pa.StructArray.from_arrays([pa.array(x) for x in (start[first], total, src[first], digest[first], at[first])], list(FIELDS))
            edges = np.searchsorted(row[first], np.arange(batch.num_rows + 1)).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(edges), values)
            yield pa.record_batch([batch.column("doc_id"), batch.column("digest"), spans], ["doc_id", "digest", "spans"])

    return found.mapInArrow(run, f"doc_id long, digest long, spans {SPAN_TYPE}")


def wanted_blocks(spans: DataFrame, k: int) -> DataFrame:
    """(doc_id, digest, parts): the blocks of each source that spans point at, as bits of (part, mask), ``PART`` blocks each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, size, src, digest, at = lists(batch, "spans", FIELDS)
            cuts = (at + size + k - 2) // BLOCK - at // BLOCK + 1
            each = np.repeat(np.arange(len(at)), cuts)
            block = at[each] // BLOCK + offsets_within(cuts)
            key = np.stack([src[each], digest[each], block // PART])
            order = np.lexsort(key)
            key = key[:, order]
            first = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])) if len(order) else order
            mask = np.bitwise_or.reduceat(np.int64(1) << (block[order] % PART), first) if len(order) else order
            yield batch_of(dict(zip(("doc_id", "digest", "part", "mask"), (*key[:, first], mask), strict=True)))

    bits = spans.select("spans").mapInArrow(run, "doc_id long, digest long, part long, mask long")
    bits = bits.groupBy("doc_id", "digest", "part").agg(F.bit_or("mask").alias("mask"))
    return bits.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("part", "mask")).alias("parts"))


def coordinate_words(joined: DataFrame, k: int) -> DataFrame:
    """The words of source blocks and of spans, cut where blocks of their source end.

    A source row has (src_doc, src_digest, block, words). The cuts that a slice of
    documents takes from one block are one row of the same key with an array of
    ``cuts``: first word and number of words within the block, own words, and
    (doc_id, digest, start).
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(utf8(batch.column("text")), 0)
        ids, digests = numbers(batch, "doc_id"), numbers(batch, "digest")

        def texts(row: np.ndarray, local: np.ndarray, n: np.ndarray) -> pa.Array:
            begin = words.first_word[row] + local
            end = np.minimum(begin + n, words.first_word[row + 1])
            return pa.array([words.joined(x, y) for x, y in zip(begin.tolist(), end.tolist(), strict=True)], pa.string())

        p_row, part, mask = lists(batch, "parts", ("part", "mask"))
        which, bit = np.nonzero((mask[:, None] >> np.arange(PART)) & 1)
        b_row, block = p_row[which], part[which] * PART + bit
        source = [pa.array(ids[b_row]), pa.array(digests[b_row]), pa.array(block), texts(b_row, block * BLOCK, np.full(len(block), BLOCK)), pa.nulls(len(block), CUTS)]

        row, start, size, src, src_digest, at = lists(batch, "spans", FIELDS)
        stop = at + size + k - 1
        count = (stop - 1) // BLOCK - at // BLOCK + 1
        each = np.repeat(np.arange(len(row)), count)
        t_block = at[each] // BLOCK + offsets_within(count)
        order = np.lexsort((t_block, src_digest[each], src[each]))
        each, t_block = each[order], t_block[order]
        low = np.maximum(at[each], t_block * BLOCK)
        n = np.minimum(stop[each], (t_block + 1) * BLOCK) - low
        local = start[each] + low - at[each]
        own = row[each]
        values = [pa.array(low - t_block * BLOCK), pa.array(n), texts(own, local, n), pa.array(ids[own]), pa.array(digests[own]), pa.array(local)]
        key = np.stack([src[each], src_digest[each], t_block])
        first = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])) if len(each) else each
        edges = pa.array(np.append(first, len(each)).astype(np.int32))
        cuts = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays(values, [f.name for f in CUTS.value_type]))
        target = [*(pa.array(x) for x in key[:, first]), pa.nulls(len(first), pa.string()), cuts.cast(CUTS)]
        return pa.record_batch([pa.concat_arrays(both) for both in zip(source, target, strict=True)], ["src_doc", "src_digest", "block", "words", "cuts"])

    return map_text(joined, step, f"src_doc long, src_digest long, block long, words string, cuts {CUT_TYPE}", limit=SLICE)


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, text) of the rows that take part; the digest tells texts of a repeated id apart."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain = plain.where("doc_id is not null and text is not null")
    return plain.select("doc_id", F.xxhash64("text").alias("digest"), "text")


def candidate_spans(plain: DataFrame, k: int, m: int) -> DataFrame:
    """(doc_id, digest, spans): the windows that a smaller document seems to have, with their sources."""
    paths = stretch_rows(plain, k, m, places=False).groupBy("gram").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.min("path").alias("p"), F.max("path").alias("q")
    )
    kinds = materialize(
        paths.where("first_doc <> last_doc").select("gram", "first_doc", (F.col("p") == F.col("q")).alias("same")), "paths"
    )
    found = materialize(stretch_rows(plain, k, m, places=True).join(kinds, "gram"), "stretches")
    heads = found.where("same and doc_id = first_doc").groupBy("gram")
    heads = heads.agg(F.min("doc_id").alias("src_doc"), F.min_by("digest", "place").alias("src_digest"), F.min("place").alias("src_place"))
    # written out, so that the join below has an exchange on either side and a hot path can be split
    heads = materialize(heads, "heads")
    whole = (
        found.where("same and doc_id > first_doc")
        .join(heads, "gram")
        .selectExpr(
            "doc_id", "digest", f"place div {PLACE} as start", f"place % {PLACE} as size", "src_doc", "src_digest", f"src_place div {PLACE} as src_start"
        )
    )
    branching = found.where("not same").groupBy("doc_id", "digest").agg(F.collect_set("place").alias("places"))
    windows = materialize(window_rows(plain.join(branching, ["doc_id", "digest"]), k), "windows")
    firsts = windows.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("src_doc"), F.max("doc_id").alias("last_doc"),
        F.min_by(F.struct("digest", "start"), "doc_id").alias("src"),  # of one row, where an id has several texts
    )
    firsts = firsts.where("src_doc <> last_doc").selectExpr("h1", "h2", "src_doc", "src.digest as src_digest", "src.start as src_start")
    firsts = materialize(firsts, "windows")
    single = (
        windows.join(firsts, ["h1", "h2"])
        .where("doc_id > src_doc")
        .select("doc_id", "digest", "start", F.lit(1).cast("long").alias("size"), "src_doc", "src_digest", "src_start")
    )
    each = whole.unionByName(single).groupBy("doc_id", "digest").agg(F.collect_set(F.struct(*FIELDS)).alias("spans"))
    out = materialize(merged(each), "spans")
    release(kinds, found, heads, windows, firsts)
    return out


def differing(plain: DataFrame, spans: DataFrame, k: int) -> DataFrame:
    """(doc_id, digest, start, n): words of spans that are not those at the coordinates of their source."""
    wanted = wanted_blocks(spans, k).join(spans, ["doc_id", "digest"], "full")
    rows = materialize(coordinate_words(plain.join(wanted, ["doc_id", "digest"]), k), "words")
    key = ["src_doc", "src_digest", "block"]
    sources = materialize(rows.where("cuts is null").groupBy(*key).agg(F.first("words").alias("source")), "sources")

    def differs(cut: Column) -> Column:
        own = F.array_join(F.slice("parts", (cut.low + 1).cast("int"), cut.n.cast("int")), " ")
        return F.coalesce(own != cut.words, F.lit(True))

    met = rows.where("cuts is not null").select(*key, "cuts").join(sources, key, "left").withColumn("parts", F.split("source", " "))
    out = met.select(F.explode(F.filter("cuts", differs)).alias("cut")).select("cut.doc_id", "cut.digest", "cut.start", "cut.n")
    out = materialize(out, "differing")
    release(rows, sources)
    return out


def regrouped(plain: DataFrame, spans: DataFrame, wrong: DataFrame, k: int, m: int) -> DataFrame:
    """Spans without the windows over differing words, and all windows of their minimizers as their words decide."""
    parts = wrong.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("start", F.col("n").alias("size"))).alias("wrong"))

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, size = lists(batch, "spans", ("start", "size"))
            w_row, w_start, w_n = lists(batch, "wrong", ("start", "size"))
            out = []
            for i in range(batch.num_rows):
                each = np.unique(np.concatenate([np.arange(a, a + n) for a, n in zip(start[row == i], size[row == i], strict=True)] or [np.zeros(0, np.int64)]))
                for a, n in zip(w_start[w_row == i], w_n[w_row == i], strict=True):
                    each = each[(each <= a - k) | (each >= a + n)]
                out.append([{"start": int(x), "size": 1} for x in each])
            yield pa.record_batch([batch.column("doc_id"), batch.column("digest"), pa.array(out, PAIRS)], ["doc_id", "digest", "spans"])

    def grams(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(utf8(batch.column("text")), 1)
        doc, first, count, gram = words.stretches(k, m)
        local = first - words.first_word[doc]
        row, start, n = lists(batch, "wrong", ("start", "size"))
        hit = np.zeros(len(gram), bool)
        for r, a, size in zip(row, start, n, strict=True):
            hit |= (doc == r) & (local < a + size) & (local + count + k - 1 > a)
        return batch_of({"gram": signed(np.unique(gram[hit]))})

    key = ["doc_id", "digest"]
    rest = spans.join(parts, key, "left").mapInArrow(without, f"doc_id long, digest long, spans {PAIR_TYPE}")
    again = materialize(map_text(plain.join(parts, key), grams, "gram long", limit=SLICE).distinct(), "grams")
    places = stretch_rows(plain, k, m, places=True).join(again, "gram").groupBy(*key).agg(F.collect_set("place").alias("places"))
    windows = materialize(window_rows(plain.join(places, key), k, words_too=True), "windows")
    firsts = windows.groupBy("words").agg(F.min("doc_id").alias("src_doc"), F.max("doc_id").alias("last_doc"))
    firsts = materialize(firsts.where("src_doc <> last_doc").drop("last_doc"), "windows")
    exact = windows.join(firsts, "words").where("doc_id > src_doc").groupBy(*key)
    exact = exact.agg(F.collect_set(F.struct("start", F.lit(1).cast("long").alias("size"))).alias("spans"))
    out = materialize(rest.unionByName(exact).groupBy(*key).agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    release(again, windows, firsts)
    return out


def repeated_spans(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """(doc_id, digest, spans): the windows that go, as an array of (start, size, ...), size windows from word start."""
    plain = numbered(docs)
    spans = candidate_spans(plain, k, m)
    wrong = differing(plain, spans, k)
    if wrong.isEmpty():
        out = spans
    else:
        out = regrouped(plain, spans, wrong, k, m)
        release(spans)
    release(wrong)
    return out


def covered(n_words: int, spans: np.ndarray, k: int) -> np.ndarray:
    """Which words the windows cover."""
    marks = np.zeros(n_words + 1, np.int32)
    np.add.at(marks, spans[:, 0], 1)
    np.add.at(marks, np.minimum(spans.sum(axis=1) + k - 1, n_words), -1)
    return np.cumsum(marks[:-1]) > 0


SPANS = "_lodestone_spans"  # so named that it meets no column of the input


def spans_of(batch: pa.RecordBatch, name: str = SPANS) -> list[np.ndarray]:
    """The spans of each row as an array of (start, size); null is none."""
    row, start, size = lists(batch, name, ("start", "size"))
    edges = np.searchsorted(row, np.arange(1, batch.num_rows))
    return np.split(np.stack([start, size], axis=1), edges)


def with_spans(docs: DataFrame, k: int, m: int) -> DataFrame:
    spans = repeated_spans(docs, k, m).select(
        F.col("doc_id").alias("_lodestone_doc"), F.col("digest").alias("_lodestone_digest"), F.col("spans").alias(SPANS)
    )
    same = (docs.doc_id.cast("long") == spans["_lodestone_doc"]) & (F.xxhash64(docs.text.cast("string")) == spans["_lodestone_digest"])
    return docs.join(by_key(spans), same, "left").drop("_lodestone_doc", "_lodestone_digest")


def kept_words(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """One row per document: n_words, n_removed, digest of the kept words."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column("text"))
        total, removed, digests = [], [], []
        for text, spans in zip(texts, spans_of(batch), strict=True):
            words = text.split()
            total.append(len(words))
            gone = 0
            if len(spans):
                marks = covered(len(words), spans, k)
                gone = int(marks.sum())
                words = [w for w, x in zip(words, marks.tolist(), strict=True) if not x]
            removed.append(gone)
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.record_batch(
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    return map_text(with_spans(plain, k, m), step, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """Documents without the repeated words, in the columns of the input.

    White space between kept words stays as it was; a cut runs to the start of
    the next kept word. A document that loses all its words goes. ``n_chars``,
    if there is one, is counted anew for changed texts.
    """
    names = docs.columns

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, keep = [], []
        olds = batch.column("text").to_pylist()
        changed = []
        for text, spans in zip(olds, spans_of(batch), strict=True):
            changed.append(bool(len(spans)))
            if not len(spans):
                texts.append(text)
                keep.append(True)
                continue
            raw = text.encode()
            words = Words([raw], 0)
            marks = covered(len(words.starts), spans, k)
            keep.append(not marks.all())
            limits = np.append(words.starts, len(raw))
            edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
            out, at = [], 0
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                out.append(raw[at : limits[a]])
                at = limits[b]
            texts.append(b"".join([*out, raw[at:]]).decode())
        columns = {n: batch.column(n) for n in names} | {"text": pa.array(texts, pa.string())}
        if "n_chars" in columns:
            old = columns["n_chars"].to_pylist()
            new = [len(t) if c else o for t, c, o in zip(texts, changed, old, strict=True)]
            columns["n_chars"] = pa.array(new, columns["n_chars"].type)
        return pa.record_batch(list(columns.values()), list(columns)).filter(pa.array(keep))

    return map_text(with_spans(docs, k, m), step, docs.schema)
