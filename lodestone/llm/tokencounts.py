"""Edit-aware token counts: a segment tree of pre-token counts per document, kept as a table.

A text is cut into pre-tokens by the tokenizer's pattern; tokens never cross
them, so a document has as many tokens as its pre-tokens together. Pre-tokens lie
in blocks; the blocks' token counts are the leaves of a segment tree whose inner
nodes are sums. An edit replaces a range of characters. All edits of a document
are done in one pass from left to right: only the pre-tokens around an edit are
matched again, starting before every one whose match could have looked at the
edited range, and ending where the new boundaries meet the old ones. Only those
are encoded; they go into the block of the first, and the sums above the blocks
touched are updated. A tree is built anew when a block has grown fourfold.

Tables: ``build_state`` gives (doc_id, digest, n_tokens, n_pretokens, lengths,
counts, blocks, sums), the tree of each text; an edit is a row (doc_id, digest,
start, end, new), the digest being that of the text it was made for;
``apply_edits`` joins both with the texts and gives the trees after the edits.

The registered query builds the state of every document, makes a table of
redaction edits (e-mail addresses and long digit runs become placeholders), the
usual edits of a training corpus, and applies it; it reports the counts before
and after and how many pre-tokens had to be encoded again.

Defined results: a null text counts as empty and has no tokens; a null id is an
id like any other. Repeated rows give a row each, and an edit of their key edits
each; a repeated edit counts once. Rows of one id with different texts are told
apart by their digests. Overlapping edits or edits beyond the text are refused;
an edit may insert, delete or replace. Very long texts are handled one at a
time, in time linear in text and edits. An empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, materialize

LOOK = 2
"""How far past its end a match may have looked: one character ends a run; a space run gives one back after looking past its end."""
MEMO_LIMIT = 300_000
EDITS = regex.compile(r"(?P<mail>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)|(?P<digits>\d{7,})")
MAY_EDIT = r"@|\p{Nd}{7}"  # in the JVM's dialect: every text with a redaction has one of these
PLACEHOLDERS = {"mail": "[EMAIL]", "digits": "[NUMBER]"}


class Tokenizer:
    """Pre-tokens and token counts of one byte-level BPE vocabulary."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[str, int] = {}

    def ends(self, text: str, start: int = 0) -> Iterable[int]:
        """Ends of the pre-tokens from a boundary on."""
        return (m.end() for m in self.pattern.finditer(text, start))

    def count(self, piece: str) -> int:
        found = self.memo.get(piece)
        if found is None:
            found = len(self.encoding.encode_ordinary(piece))
            if len(piece) <= 64:
                if len(self.memo) >= MEMO_LIMIT:
                    self.memo.clear()
                self.memo[piece] = found
        return found


BLOCK = 64
KEY = ("doc_id", "digest")
EDIT = "doc_id long, digest long, start long, end long, new string"
PACKED = ("lengths", "counts", "blocks", "sums")
STATE_COLUMNS = ("n_tokens", "n_pretokens", *PACKED)
STATE = "doc_id long, digest long, n_tokens long, n_pretokens long, lengths binary, counts binary, blocks binary, sums binary"


def packed(x: np.ndarray) -> bytes:
    """Counts as bytes: the width of a number, then the numbers in the least width that holds them."""
    top = int(x.max()) if len(x) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def pair_sums(x: np.ndarray) -> np.ndarray:
    if len(x) & 1:
        x = np.append(x, 0)
    return x[::2] + x[1::2]


class SegmentTree:
    """Sums over leaves; ``levels[0]`` are the leaves, the last level is the total."""

    def __init__(self, leaves: np.ndarray):
        self.levels = [leaves]
        while len(self.levels[-1]) > 1:
            self.levels.append(pair_sums(self.levels[-1]))

    @classmethod
    def restored(cls, n_leaves: int, sums: np.ndarray) -> SegmentTree:
        tree, at, n = cls.__new__(cls), 0, n_leaves
        tree.levels = [sums[:n]]
        while n > 1:
            at, n = at + n, (n + 1) // 2
            tree.levels.append(sums[at : at + n])
        return tree

    @property
    def total(self) -> int:
        return int(self.levels[-1][0]) if len(self.levels[-1]) else 0

    def update(self, places: np.ndarray, values: np.ndarray) -> None:
        """New values of some leaves (places in order, each once); only the sums above them are taken again."""
        self.levels[0][places] = values
        for below, above in zip(self.levels, self.levels[1:], strict=False):
            places = np.unique(places // 2)
            left, right = 2 * places, np.minimum(2 * places + 1, len(below) - 1)
            above[places] = below[left] + np.where(right > left, below[right], 0)

    def range_sum(self, start: int, end: int) -> int:
        total, depth = 0, 0
        while start < end:
            level = self.levels[depth]
            if start & 1:
                total += int(level[start])
                start += 1
            if end & 1:
                end -= 1
                total += int(level[end])
            start, end, depth = start // 2, end // 2, depth + 1
        return total


class CountedText:
    """A text with its pre-token boundaries and counts, and the tree over blocks of them."""

    def __init__(self, text: str, tokenizer: Tokenizer):
        self.text, self.tokenizer, self.encoded = text, tokenizer, 0
        pieces = tokenizer.pattern.findall(text)
        memo, count = tokenizer.memo, tokenizer.count
        self.counts = np.array([memo.get(p) or count(p) for p in pieces], np.int64)
        self.ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        self.build()

    def build(self) -> None:
        n = len(self.counts)
        self.blocks = np.diff(np.append(np.arange(0, n, BLOCK), n))
        self.tree = SegmentTree(np.add.reduceat(self.counts, np.arange(0, n, BLOCK)) if n else self.counts)

    def stored(self) -> tuple[int, int, bytes, bytes, bytes, bytes]:
        """n_tokens, n_pretokens and the packed columns of the state table."""
        lengths = np.diff(self.ends, prepend=0)
        sums = np.concatenate(self.tree.levels)
        return self.tree.total, len(self.counts), packed(lengths), packed(self.counts), packed(self.blocks), packed(sums)

    @classmethod
    def restored(cls, text: str, tokenizer: Tokenizer, lengths: bytes, counts: bytes, blocks: bytes, sums: bytes) -> CountedText:
        out = cls.__new__(cls)
        out.text, out.tokenizer, out.encoded = text, tokenizer, 0
        out.ends, out.counts, out.blocks = np.cumsum(unpacked(lengths)), unpacked(counts), unpacked(blocks)
        out.tree = SegmentTree.restored(len(out.blocks), unpacked(sums))
        return out

    def edit(self, start: int, end: int, new: str) -> None:
        self.edit_all([(start, end, new)])

    def edit_all(self, edits: list[tuple[int, int, str]]) -> None:
        """Edits given in places of the text as it is now, in order and apart: one pass, one splice."""
        if any(a[1] > b[0] for a, b in zip(edits, edits[1:], strict=False)):
            raise ValueError("edits overlap or are out of order")
        if any(not 0 <= a <= b <= len(self.text) for a, b, _ in edits):
            raise ValueError("edits lie beyond the text")
        if not edits:
            return
        parts, at = [], 0
        for start, end, new in edits:
            parts += (self.text[at:start], new)
            at = end
        after = "".join([*parts, self.text[at:]])
        begins = np.array([e[0] for e in edits], np.int64)
        firsts = np.searchsorted(self.ends, begins - LOOK, side="right").tolist()
        olds = np.searchsorted(self.ends, np.array([e[1] for e in edits], np.int64)).tolist()
        ends, count = self.ends.tolist(), self.tokenizer.count
        n, find = len(ends), self.tokenizer.pattern.finditer
        regions: list[tuple[int, int, int]] = []  # first and last old pre-token that go, how many fresh ones come
        fresh: list[int] = []
        fresh_counts: list[int] = []
        shifts: list[int] = []  # of the old boundaries behind each region
        stop = shift = k = 0
        while k < len(edits):
            first = max(firsts[k], stop)
            at = (ends[first - 1] if first else 0) + shift
            limit = edits[k][0] + shift + len(edits[k][2])  # where the new text of the last edit taken in ends
            shift += len(edits[k][2]) - (edits[k][1] - edits[k][0])
            old, k = olds[k], k + 1  # the first old boundary at or past the edit
            stop, had, bound, matches = n, len(fresh), at, find(after, at)
            while True:
                while k < len(edits) and bound - shift > edits[k][0]:  # the next edit is reached as well
                    limit = edits[k][0] + shift + len(edits[k][2])
                    shift += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                    old, k = max(old, olds[k]), k + 1
                if bound >= limit:
                    while old < n and ends[old] + shift < bound:
                        old += 1
                    if old < n and ends[old] + shift == bound:
                        stop = old + 1
                        break
                m = next(matches, None)
                if m is None:
                    break
                fresh_counts.append(count(after[bound : m.end()]))
                bound = m.end()
                fresh.append(bound)
            regions.append((first, stop, len(fresh) - had))
            shifts.append(shift)
        self.splice(np.array(regions, np.int64), np.array(shifts, np.int64), np.array(fresh, np.int64), np.array(fresh_counts, np.int64))
        self.text = after
        self.encoded += len(fresh)

    def splice(self, regions: np.ndarray, shifts: np.ndarray, fresh: np.ndarray, fresh_counts: np.ndarray) -> None:
        first, stop, come = regions.T
        block_of = np.repeat(np.arange(len(self.blocks)), self.blocks)
        going = np.repeat(first, stop - first) + np.arange(int((stop - first).sum())) - np.repeat(np.cumsum(stop - first) - (stop - first), stop - first)
        n, n_blocks = len(self.ends), len(self.blocks)
        kept = np.ones(n, bool)
        kept[going] = False
        behind = np.zeros(n + 1, np.int64)
        np.add.at(behind, stop, np.diff(shifts, prepend=0))
        moved = self.ends + np.cumsum(behind)[:n]
        places = np.repeat(first, come)  # where in the old order the fresh ones stand
        old_counts, order = self.counts, np.argsort(np.concatenate([2 * np.flatnonzero(kept) + 1, 2 * places]), kind="stable")
        self.ends = np.concatenate([moved[kept], fresh])[order]
        self.counts = np.concatenate([old_counts[kept], fresh_counts])[order]
        if not n_blocks or not len(self.counts):
            self.build()
            return
        home = block_of[np.minimum(places, n - 1)]
        change = np.bincount(home, minlength=n_blocks) - np.bincount(block_of[going], minlength=n_blocks)
        sums = np.bincount(home, fresh_counts, n_blocks) - np.bincount(block_of[going], old_counts[going], n_blocks)
        self.blocks = self.blocks + change
        if self.blocks.max() > 4 * BLOCK:
            self.build()
            return
        dirty = np.unique(np.concatenate([home, block_of[going]]))
        self.tree.update(dirty, self.tree.levels[0][dirty] + sums[dirty].astype(np.int64))

    def range_sum(self, start: int, end: int) -> int:
        """Tokens of the pre-tokens start..end-1: whole blocks from the tree, the rest from the counts."""
        edges = np.concatenate([[0], np.cumsum(self.blocks)])
        low, high = int(np.searchsorted(edges, start)), int(np.searchsorted(edges, end, side="right")) - 1
        if low >= high:
            return int(self.counts[start:end].sum())
        outer = self.counts[start : edges[low]].sum() + self.counts[edges[high] : end].sum()
        return int(outer) + self.tree.range_sum(low, high)


@lru_cache(2)
def tokenizer_at(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def redactions(text: str) -> list[tuple[int, int, str]]:
    """The edits that replace e-mail addresses and long digit runs."""
    return [(m.start(), m.end(), PLACEHOLDERS[m.lastgroup]) for m in EDITS.finditer(text)]


def keyed(df: DataFrame) -> DataFrame:
    """(doc_id, digest, text): null texts are empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def build_state(docs: DataFrame, own: tuple[str, str]) -> DataFrame:
    """The tree of every text of ``keyed`` rows; other columns than the text stay."""
    kept = [c for c in docs.columns if c != "text"]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokenizer = tokenizer_at(*own)
        rows = [CountedText(text, tokenizer).stored() for text in batch.column("text").to_pylist()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 2 + [pa.binary()] * 4, strict=True)]
        return pa.record_batch([*(batch.column(c) for c in kept), *columns], [*kept, *STATE_COLUMNS])

    schema = docs.select(*kept).schema
    for name in STATE_COLUMNS:
        schema = schema.add(name, "binary" if name in PACKED else "long")
    return map_text(docs, step, schema)


def redaction_edits(docs: DataFrame) -> DataFrame:
    """A row per redaction of each text of ``keyed`` rows."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [redactions(text) for text in batch.column("text").to_pylist()]
        rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        starts, ends, news = zip(*[e for f in found for e in f], strict=True) if len(rows) else ((), (), ())
        columns = [batch.column(c).take(rows) for c in KEY]
        return pa.record_batch([*columns, pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(news, pa.string())], [*KEY, "start", "end", "new"])

    return map_text(docs, step, EDIT)


def with_key(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join by the key, null ids like any other."""
    renamed = right.withColumnsRenamed({c: f"_{c}" for c in KEY})
    same = left.doc_id.eqNullSafe(renamed["_doc_id"]) & (left.digest == renamed["_digest"])
    return left.join(renamed, same, how).drop(*[f"_{c}" for c in KEY])


def apply_edits(docs: DataFrame, state: DataFrame, edits: DataFrame, own: tuple[str, str]) -> DataFrame:
    """The state after the edits, of the documents that have some, with n_edits and n_encoded_again.

    Texts and trees go through a shuffle by key, so leave out documents that are known to have no edit.
    """
    listed = edits.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("start", "end", "new"))).alias("edits"))
    # repeated rows have one state; taken once, so that the join below has a row per document row
    touched = with_key(state.select(*KEY, *PACKED), listed).dropDuplicates(list(KEY))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokenizer = tokenizer_at(*own)
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("text", *PACKED, "edits"))
        for text, lengths, counts, blocks, sums, own_edits in zip(*columns, strict=True):
            counted = CountedText.restored(text, tokenizer, lengths, counts, blocks, sums)
            counted.edit_all([(e["start"], e["end"], e["new"]) for e in own_edits])
            rows.append((*counted.stored(), len(own_edits), counted.encoded))
        types = [pa.int64()] * 2 + [pa.binary()] * 4 + [pa.int64()] * 2
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.record_batch([batch.column("doc_id"), batch.column("digest"), *arrays], [*KEY, *STATE_COLUMNS, "n_edits", "n_encoded_again"])

    return map_text(with_key(docs, touched), step, f"{STATE}, n_edits long, n_encoded_again long")


def token_counts(df: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per document: tokens and pre-tokens as it is, edits, pre-tokens encoded again, tokens after the edits."""
    own = default_tokenizer() if path is None else (path, pattern)
    docs = keyed(df)
    state = materialize(build_state(docs.withColumn("may_edit", F.col("text").rlike(MAY_EDIT)), own), "trees", compression="zstd")
    some = docs.where(F.col("text").rlike(MAY_EDIT))
    after = apply_edits(some, state.where("may_edit"), redaction_edits(some), own)
    after = after.groupBy(*KEY).agg(F.max("n_edits").alias("n_edits"), F.max("n_encoded_again").alias("n_encoded_again"), F.max("n_tokens").alias("n_tokens_after"))
    rows = with_key(state.select(*KEY, "n_tokens", "n_pretokens"), materialize(after, "edited"), "left")
    return rows.select(
        "doc_id", "n_tokens", "n_pretokens", F.coalesce("n_edits", F.lit(0)).alias("n_edits"),
        F.coalesce("n_encoded_again", F.lit(0)).alias("n_encoded_again"), F.coalesce("n_tokens_after", "n_tokens").alias("n_tokens_after"),
    )
