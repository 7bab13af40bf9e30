"""Benchmark decontamination with a generalised suffix automaton over words.

The test items (normalised to words) go into suffix automata. A document is
streamed through one word by word; the automaton keeps the length of the longest
suffix of what was read that some item contains. Once that length reaches the
window, the last ``window`` words are a window of an item, and the state says of
which items. An item shorter than the window is one window.

Only stretches whose every adjacent pair of words is a pair of some item are
streamed: elsewhere the matched length is at most one, so that the automaton
would be back at its root. Pairs are looked up in a bitmap; its false hits only
cost time.

Items are cut into pieces of bounded length that overlap by a window less one
word, repeated pieces are dropped, and the pieces are dealt into shards of about
``shard_words`` words. Spark builds a shard's automaton in one task, as flat
arrays, and writes it to a table. The documents go through the automata in
passes: a pass takes shards of ``RESIDENT_WORDS`` words together, which the
driver passes on one by one as broadcasts (about 60 bytes a word), and a Python
worker unpacks each of them once and keeps it. What a pass has marked is written
with the documents and read by the next; its broadcasts are dropped then. So
neither a worker nor the driver ever has more than the automata of one pass.

Defined results: a null text has no words and no hits. Items without words, or
with a null id, take no part. Repeated item ids count once. Repeated documents
give a row each; very long texts are handled one at a time. Empty tables give no
hits, or no rows. Extra columns are ignored by ``contamination`` and pass
through ``decontaminate``.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_ONLY, map_text, materialize, release, utf8

WINDOW = 10
SHARD_WORDS = 250_000
RESIDENT_WORDS = 1_000_000
PIECE_WORDS = 2_000
PAIR_BITS = 22
N_WORDS, SPANS, ITEMS = "_lodestone_words", "_lodestone_spans", "_lodestone_items"  # so named that they meet no column of the input
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_ONLY).split()


class Builder:
    """A suffix automaton while it is being built, with a dict of moves per state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def extend(self, last: int, code: int) -> int:
        known = self.next[last].get(code)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self.split(last, code, known)
        new = self.add(self.length[last] + 1, {})
        at = last
        while at != -1 and code not in self.next[at]:
            self.next[at][code] = new
            at = self.link[at]
        if at == -1:
            self.link[new] = 0
        else:
            q = self.next[at][code]
            self.link[new] = q if self.length[q] == self.length[at] + 1 else self.split(at, code, q)
        return new

    def add(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def split(self, at: int, code: int, q: int) -> int:
        copy = self.add(self.length[at] + 1, dict(self.next[q]))
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while at != -1 and self.next[at].get(code) == q:
            self.next[at][code] = copy
            at = self.link[at]
        return copy


def pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (mixed >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def rows_of(pairs: set[tuple[int, ...]], n: int) -> tuple[np.ndarray, ...]:
    """Tuples that begin with a state as flat columns, and where each state's begin."""
    table = np.array(sorted(pairs), np.int64).reshape(len(pairs), -1) if pairs else np.zeros((0, 3), np.int64)
    return np.searchsorted(table[:, 0], np.arange(n + 1)).astype(np.int32), *table.T[1:]


@dataclass
class SuffixAutomaton:
    """All factors of some word sequences as flat arrays; for each state the items whose windows end in it."""

    window: int
    least: int
    size: int
    words: bytes
    root: np.ndarray  # target per code
    first: np.ndarray  # where a state's moves begin
    codes: np.ndarray
    targets: np.ndarray
    link: np.ndarray
    length: np.ndarray
    anchor: np.ndarray  # the state of the last ``window`` words
    own_first: np.ndarray
    own_items: np.ndarray
    short_state: np.ndarray  # the nearest state on the way to the root with items shorter than the window
    short_first: np.ndarray
    short_sizes: np.ndarray
    short_items: np.ndarray
    pairs: np.ndarray

    @classmethod
    def build(cls, items: list[tuple[int, list[bytes]]], window: int = WINDOW) -> SuffixAutomaton:
        """From (item, words); an item may come in pieces, of which only a whole item is shorter than the window."""
        vocabulary: dict[bytes, int] = {}
        made, coded = Builder(), []
        for item, words in items:
            if words and item is not None:
                coded.append((item, [vocabulary.setdefault(w, len(vocabulary)) for w in words]))
        for _, codes in coded:
            last = 0
            for code in codes:
                last = made.extend(last, code)
        n = len(made.next)
        length, link = made.length, made.link
        anchor = list(range(n))
        order = np.argsort(length, kind="stable").tolist()
        for v in order[1:]:  # shorter ones first
            anchor[v] = anchor[link[v]] if length[link[v]] >= window else v
        own: set[tuple[int, ...]] = set()
        short: set[tuple[int, ...]] = set()
        for item, codes in coded:
            v = 0
            for i, code in enumerate(codes):
                v = made.next[v][code]
                if i + 1 >= window:
                    own.add((anchor[v], item))
            if len(codes) < window:
                short.add((v, len(codes), item))
        own_first, own_items = rows_of({(*o, 0) for o in own}, n)[:2]
        short_first, short_sizes, short_items = rows_of(short, n)
        short_state = [0] * n
        for v in order[1:]:
            short_state[v] = v if short_first[v + 1] > short_first[v] else short_state[link[v]]
        root = np.full(len(vocabulary), -1, np.int32)
        root[list(made.next[0])] = list(made.next[0].values())
        moves = [sorted(m.items()) for m in made.next[1:]]
        first = np.concatenate([[0, 0], np.cumsum([len(m) for m in moves])]).astype(np.int32)
        flat = np.array([x for m in moves for x in m], np.int32).reshape(-1, 2)
        pairs = np.zeros(1 << PAIR_BITS, bool)
        for _, codes in coded:
            c = np.array(codes, np.int64)
            pairs[pair_slot(c[:-1], c[1:])] = True
        return cls(
            window, min([window, *(len(codes) for _, codes in coded)]), sum(len(codes) for _, codes in coded), b" ".join(vocabulary), root, first,
            np.ascontiguousarray(flat[:, 0]), np.ascontiguousarray(flat[:, 1]), np.array(link, np.int32), np.array(length, np.int32),
            np.array(anchor, np.int32), own_first, own_items, np.array(short_state, np.int32), short_first, short_sizes, short_items, pairs,
        )

    def unpacked(self) -> SuffixAutomaton:
        """Ready to scan: the dict of words, and views of the arrays that give plain numbers."""
        self.vocabulary = {w: i for i, w in enumerate(self.words.split())}
        names = ("root", "first", "codes", "targets", "link", "length", "anchor", "own_first", "short_state", "short_first", "short_sizes")
        for name in names:
            setattr(self, f"_{name}", memoryview(getattr(self, name)))
        return self

    def scan(self, words: list[bytes]) -> tuple[list[int], set[int]]:
        """Merged hit spans as [start, end, start, end ...] in words, and the items hit."""
        if len(words) < self.least or not self.vocabulary:
            return [], set()
        get = self.vocabulary.get
        codes = np.array([get(w, -1) for w in words], np.int64)
        if self.least == 1:
            runs = [(0, len(words))]
        else:
            good = self.pairs[pair_slot(codes[:-1], codes[1:])] & (codes[:-1] >= 0) & (codes[1:] >= 0)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], good.view(np.int8), [0]])))
            starts, ends = edges[::2], edges[1::2] + 1
            long = ends - starts >= self.least
            runs = list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))
        spans: list[int] = []
        whole: set[int] = set()
        parts: set[int] = set()
        for start, end in runs:
            self.stream(codes[start:end].tolist(), start, spans, whole, parts)
        hit: set[int] = set()
        for v in whole:
            hit.update(self.own_items[self.own_first[v] : self.own_first[v + 1]].tolist())
        for v in parts:
            hit.update(self.short_items[self.short_first[v] : self.short_first[v + 1]].tolist())
        return spans, hit

    def move(self, v: int, code: int) -> int:
        """Where a word leads from a state; -1 nowhere."""
        if not v:
            return self._root[code] if code >= 0 else -1
        low, high = self._first[v], self._first[v + 1]
        at = low if high - low == 1 else bisect_left(self._codes, code, low, high)
        return self._targets[at] if at < high and self._codes[at] == code else -1

    def stream(self, codes: list[int], base: int, spans: list[int], whole: set[int], parts: set[int]) -> None:
        """Follow the words; note the states of whole windows and of short items that end at a word."""
        v = matched = 0
        link, length, window, move = self._link, self._length, self.window, self.move
        for i, code in enumerate(codes):
            to = move(v, code)
            while to < 0 and v:
                v = link[v]
                matched = length[v]
                to = move(v, code)
            if to < 0:
                matched = 0
                continue
            v, matched = to, matched + 1
            reach = 0
            if matched >= window:
                state = self._anchor[v]
                if self._own_first[state + 1] > self._own_first[state]:
                    reach = window
                    whole.add(state)
            u = self._short_state[v]
            while u:
                size = self._short_sizes[self._short_first[u]]  # one size a state, as a short item is a state's longest sequence
                if size <= matched:
                    reach = max(reach, size)
                    parts.add(u)
                u = self._short_state[link[u]]
            if reach:
                start, end = base + i + 1 - reach, base + i + 1
                while spans and spans[-1] >= start:
                    spans.pop()
                    start = min(start, spans.pop())
                spans += [start, end]


def pieces_of(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, n, words): distinct pieces of the items, overlapping by a window less one word."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for item, text in zip(batch.column("item_id").to_pylist(), utf8(batch.column("text")), strict=True):
            words = words_of(text)
            for at in range(0, max(len(words) - window + 1, min(len(words), 1)), PIECE_WORDS):
                piece = words[at : at + PIECE_WORDS + window - 1]
                rows.append((item, len(piece), b" ".join(piece).decode()))
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["item_id", "n", "words"])

    rows = map_text(items.where("item_id is not null and text is not null"), step, "item_id long, n long, words string")
    return rows.distinct()


def shards_of(benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(shard, n, automaton): the items' automata, each built by one task from pieces of bounded size."""
    pieces = materialize(pieces_of(benchmark, window), "pieces")
    total = pieces.agg(F.sum("n").alias("n")).first()["n"] or 0
    count = max(1, -(-total // shard_words))

    def build(table: pa.Table) -> pa.Table:
        items = zip(table.column("item_id").to_pylist(), table.column("words").to_pylist(), strict=True)
        made = SuffixAutomaton.build([(i, w.encode().split()) for i, w in items], window)
        data = pickle.dumps(made, protocol=5)
        return pa.table([table.column("shard").slice(0, 1), pa.array([made.size], pa.int64()), pa.array([data], pa.binary())], ["shard", "n", "automaton"])

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("item_id", "words"), F.lit(count)))
    out = materialize(dealt.groupBy("shard").applyInArrow(build, "shard long, n long, automaton binary"), "automata")
    release(pieces)
    return out


LOADED: dict[int, SuffixAutomaton] = {}
"""Automata of this worker by the id of their broadcast."""


def automata(sent: list[tuple[Broadcast, int]]) -> Iterator[SuffixAutomaton]:
    """The automata one after the other; as many stay as the bound on words allows."""
    for old in set(LOADED) - {number for _, number in sent}:
        del LOADED[old]
    room = RESIDENT_WORDS - sum(a.size for a in LOADED.values())
    for value, number in sent:
        found = LOADED.get(number)
        if found is None:
            found = pickle.loads(value.value).unpacked()
            value.__dict__.pop("_value", None)  # a broadcast would keep its bytes as well
            if found.size <= room:
                LOADED[number] = found
                room -= found.size
        yield found


Finish = Callable[[pa.RecordBatch], pa.RecordBatch]


def mark(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, finish: Finish | None = None
) -> DataFrame:
    """The documents' columns with N_WORDS, SPANS (hit word positions, flattened) and ITEMS.

    ``finish`` turns a marked batch into a batch of the documents' columns; it
    runs in the same Python worker.
    """
    shards = shards_of(benchmark, window, shard_words)
    rows = docs.withColumns({N_WORDS: F.lit(0).cast("long"), SPANS: F.lit(None).cast("array<int>"), ITEMS: F.lit(None).cast("array<long>")})
    passes = passes_of([(r["shard"], r["n"]) for r in shards.select("shard", "n").orderBy("shard").collect()])  # two numbers per shard
    for k, numbers in enumerate(passes):
        sent = broadcasts(shards, numbers)
        if k < len(passes) - 1:
            before, rows = rows, materialize(one_pass(rows, sent, None), "marked")
            release(before)
            for one, _ in sent:
                one.destroy()
        else:
            rows = one_pass(rows, sent, finish, docs.schema if finish else None)
    release(shards)
    return rows


def passes_of(shards: list[tuple[int, int]]) -> list[list[int]]:
    """Shard numbers, grouped so that a group has ``RESIDENT_WORDS`` words at most (or one shard); one group at least."""
    out: list[list[int]] = [[]]
    room = RESIDENT_WORDS
    for number, n in shards:
        if n > room and out[-1]:
            out.append([])
            room = RESIDENT_WORDS
        out[-1].append(number)
        room -= n
    return out


def broadcasts(shards: DataFrame, numbers: list[int]) -> list[tuple[Broadcast, int]]:
    """The automata of one pass; the driver holds one at a time and keeps the others in files."""
    sent = []
    for number in numbers:
        data = shards.where(F.col("shard") == number).first()["automaton"]
        one = shards.sparkSession.sparkContext.broadcast(bytes(data))
        sent.append((one, one._jbroadcast.id()))
    return sent


def one_pass(rows: DataFrame, sent: list[tuple[Broadcast, int]], finish: Finish | None, schema: T.StructType | None = None) -> DataFrame:
    """The rows with what the automata of one pass mark added to their marks."""
    names = [n for n in rows.columns if n not in (N_WORDS, SPANS, ITEMS)]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [words_of(t) for t in utf8(batch.column("text"))]
        spans: list[list[int]] = [s or [] for s in batch.column(SPANS).to_pylist()]
        items: list[set[int]] = [set(i or ()) for i in batch.column(ITEMS).to_pylist()]
        for automaton in automata(sent):
            for k, words in enumerate(texts):
                found, hit = automaton.scan(words)
                spans[k] += found
                items[k] |= hit
        marked = pa.record_batch(
            [
                *(batch.column(n) for n in names),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([merged(s) for s in spans], pa.list_(pa.int32())),
                pa.array([sorted(i) for i in items], pa.list_(pa.int64())),
            ],
            [*names, N_WORDS, SPANS, ITEMS],
        )
        return finish(marked) if finish else marked

    return map_text(rows, step, schema or rows.schema)


def merged(spans: list[int]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: hit words, hit items and whether there are any."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = mark(plain, benchmark, window)
    signed = F.transform(SPANS, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)
    ids = F.array_sort(F.transform(ITEMS, lambda x: x.cast("string")))
    return marked.select(
        "doc_id",
        F.col(N_WORDS).alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(ITEMS).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def cut(text: bytes, spans: list[int]) -> bytes:
    """The text without the words of the spans; each cut runs to the start of the next kept word."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for start, end in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[at : places[start][0]])
        at = places[end][0] if end < len(places) else len(text)
    return b"".join([*out, text[at:]])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_span: int = 0, max_coverage: float = 0.8
) -> DataFrame:
    """Documents without benchmark passages, in the columns of the input.

    Spans of more than ``max_span`` hit words are removed from the text; a
    document of which more than ``max_coverage`` is hit goes as a whole.
    ``n_chars``, if there is one, is counted anew for changed texts.
    """
    names = docs.columns

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, keep = [], []
        rows = zip(batch.column("text").to_pylist(), batch.column(N_WORDS).to_pylist(), batch.column(SPANS).to_pylist(), strict=True)
        for text, n, spans in rows:
            long = [x for s, e in zip(spans[::2], spans[1::2], strict=True) if e - s > max_span for x in (s, e)]
            hit = sum(long[1::2]) - sum(long[::2])
            keep.append(not n or hit <= max_coverage * n)
            texts.append(cut(text.encode(), long).decode() if long and keep[-1] else text)
        columns = {n: batch.column(n) for n in names} | {"text": pa.array(texts, pa.string())}
        if "n_chars" in columns:
            old = columns["n_chars"].to_pylist()
            changed = [len(t) if s and t is not None else o for t, s, o in zip(texts, batch.column(SPANS).to_pylist(), old, strict=True)]
            columns["n_chars"] = pa.array(changed, columns["n_chars"].type)
        return pa.record_batch(list(columns.values()), list(columns)).filter(pa.array(keep))

    return mark(docs, benchmark, window, finish=step)


def digest(ids: list[int]) -> str:
    """The digest column for a list of item ids; tests use it."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
