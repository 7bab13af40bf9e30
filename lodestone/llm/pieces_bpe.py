"""SentencePiece BPE encoding with a prefix table, and decoding.

The last token of every prefix of a text is unique: if the prefix of length
``i`` ends in token ``t``, then the prefix without ``t`` ends in a token that is
compatible with ``t`` (the pair, encoded by itself, stays that pair). An
Aho-Corasick automaton over the vocabulary gives the tokens that may end at each
position; the compatibility test picks the one that does. Reading the table
backwards from the end recovers the ids.

Texts are cut before each run of the space mark and around line feeds first: no piece of the
vocabulary has a mark after another character and none has a line feed (checked
when the model is loaded), so no merge crosses such a cut. Chunks repeat a lot
and are memoised.

A chunk is cut further at characters that no piece has (they become their bytes
and merge with nothing) and behind all but the last of its leading marks: the
pieces of several marks hold nothing else and are scored below all others
(checked as well), so they merge after everything else. What is left to merging
step by step are runs of marks alone: their pieces all share one score, so
leftmost order, not rank, decides between them and the pair test isn't sound. A
run depends on its length only.

Models that rewrite characters, drop spaces, put none before a text or have
pieces defined by users are refused when they are loaded.

Defined results: a null text counts as empty; an empty text has the begin and
end ids alone; characters outside the vocabulary fall back to their bytes.
Repeated rows and null ids give a row each. Very long words cost time in
proportion to their length; very long texts are handled one at a time. An empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
MEMO_LIMIT = 300_000
MEMO_CHARS = 64
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, BPE = 1, 2


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = read_varint(data, at)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value, at = read_varint(data, at)
        elif kind == 2:
            size, at = read_varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            value, at = data[at : at + 8], at + 8
        yield number, value


def load_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) of each id of a model file; a model that this encoder would get wrong is refused."""
    found = []
    trainer: dict = {}
    normalizer: dict = {}
    back: dict = {}
    for number, value in fields(data):
        if number == 1:
            own = {1: b"", 2: 0.0, 3: NORMAL} | dict(fields(value))
            found.append((own[1].decode(), own[2], own[3]))
        elif number in (2, 3, 5):
            {2: trainer, 3: normalizer, 5: back}[number].update(fields(value))
    if trainer.get(3, UNIGRAM) != BPE:
        raise ValueError("the model isn't a BPE model")
    if normalizer.get(2) or back.get(2):
        raise ValueError("the model rewrites characters before encoding or after decoding")
    if not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
        raise ValueError("the model must put a space before the text, keep all spaces, and mark them before words")
    if any(kind not in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, _, kind in found):
        raise ValueError("the model has pieces that users defined, or unused ones")
    return found


class PieceBpe:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes):
        self.pieces = load_model(model)
        self.rank = {p: (-s, i) for i, (p, s, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.bytes_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        if len(self.bytes_id) != 256:
            raise ValueError("the model has no byte fallback")
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.rank):
            raise ValueError("a piece has a line feed, or a space mark after another character")
        marks = [p for p in self.rank if p[:2] == MARK * 2]
        worst = max([self.rank[p][0] for p in marks], default=0)
        others = max((score for p, (score, _) in self.rank.items() if len(p) > 1 and p not in set(marks)), default=0)
        letters = set("".join(self.rank))
        if any(set(p) != {MARK} for p in marks) or (marks and (others >= worst or len({self.rank[p][0] for p in marks}) > 1)):
            raise ValueError("pieces of several space marks hold other characters or aren't scored below all others")
        if MARK not in self.rank or not letters <= set(self.rank):
            raise ValueError("a character of a piece is no piece")
        self.strange = re.compile("([^" + re.escape("".join(sorted(letters))) + "]+)")
        self.mark = self.rank[MARK][1]
        self.runs: dict[int, list[int]] = {}
        names = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == CONTROL}
        self.begin, self.end = names["<s>"], names["</s>"]
        self.automaton = ahocorasick.Automaton()
        for piece in self.rank:
            if self.merged(piece) == [piece]:  # others are never the result of merging
                self.automaton.add_word(piece, self.rank[piece][1])
        self.automaton.make_automaton()
        self.lengths = [len(p) for p, _, _ in self.pieces]
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.shown = [self.show(i) for i in range(len(self.pieces))]

    def merged(self, text: str) -> list[str]:
        """Merging step by step: the best-scored adjacent pair first, the leftmost of equals."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (hit := self.rank.get(both := parts[i] + parts[j])):
                heapq.heappush(heap, (hit[0], i, j, both))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def compatible(self, left: int, right: int) -> bool:
        """Two pieces, encoded as one text, stay these two."""
        pair = [self.pieces[left][0], self.pieces[right][0]]
        found = self.merged("".join(pair)) == pair
        if len(self.pairs) < MEMO_LIMIT:
            self.pairs[left * len(self.pieces) + right] = found
        return found

    def table(self, chunk: str) -> list[int] | None:
        """Ids of a chunk by the prefix table; none if it has a character outside the vocabulary.

        The automaton gives the pieces that end at each place, places in order,
        so the last piece of every shorter prefix is known by then.
        """
        last = [-1] * (len(chunk) + 1)
        lengths, pairs, size = self.lengths, self.pairs, len(self.pieces)
        for at, piece in self.automaton.iter(chunk):
            if last[at + 1] >= 0:
                continue
            start = at + 1 - lengths[piece]
            if start:
                before = last[start]
                if before < 0:
                    return None
                good = pairs.get(before * size + piece)
                if good is None:
                    good = self.compatible(before, piece)
                if not good:
                    continue
            last[at + 1] = piece
        found, end = [], len(chunk)
        while end:
            piece = last[end]
            if piece < 0:
                return None
            found.append(piece)
            end -= lengths[piece]
        found.reverse()
        return found

    def run(self, n: int) -> list[int]:
        """Ids of ``n`` marks alone."""
        found = self.runs.get(n)
        if found is None:
            found = [self.rank[p][1] for p in self.merged(MARK * n)]
            if n <= MEMO_CHARS:
                self.runs[n] = found
        return found

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a chunk: marks before the last by their number, the rest by prefix tables between strange characters."""
        n = len(chunk) - len(chunk.lstrip(MARK))
        if n == len(chunk):
            return self.run(n)
        if n > 1:
            rest = self.chunk_ids(chunk[n - 1 :])
            # a last mark that the word didn't take joins the others
            return self.run(n) + rest[1:] if rest[0] == self.mark else self.run(n - 1) + rest
        found = self.table(chunk)
        if found is None:
            found = []
            for k, part in enumerate(self.strange.split(chunk)):
                found += [self.bytes_id[b] for b in part.encode()] if k % 2 else self.table(part)
        return found

    def ids_of(self, chunk: str) -> bytes:
        """Ids of a chunk as little-endian unsigned 32-bit integers."""
        found = self.memo.get(chunk)
        if found is None:
            ids = self.chunk_ids(chunk)
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(chunk) <= MEMO_CHARS:
                if len(self.memo) >= MEMO_LIMIT:
                    self.memo.clear()
                self.memo[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        ends = self.begin, self.end
        if not text:
            return np.array(ends, "<u4").tobytes()
        memo, ids_of = self.memo, self.ids_of
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            chunks = CHUNK.findall(MARK + text.replace(" ", MARK))
        else:
            chunks = (MARK + text.replace(" ", f" {MARK}").replace("\n", " \n ")).split(" ")
        out = [np.array(ends[:1], "<u4").tobytes()]
        out += [memo.get(c) or ids_of(c) for c in chunks]
        out.append(np.array(ends[1:], "<u4").tobytes())
        return b"".join(out)

    def show(self, i: int) -> bytes:
        piece, _, kind = self.pieces[i]
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return bytes([int(piece[3:5], 16)]) if kind == BYTE else piece.replace(MARK, " ").encode()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids vanish, one leading space goes, broken bytes become U+FFFD."""
        shown = self.shown
        raw = b"".join([shown[i] for i in ids])
        return raw.decode(errors="replace").removeprefix(" ")


@lru_cache(2)
def model_at(path: str) -> PieceBpe:
    with open(path, "rb") as file:
        return PieceBpe(file.read())


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(df: DataFrame, model: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, digests of the ids and of the decoded text.

    ``model`` is the path of a model file that each executor has; by default the
    public one. With ``keep_ids`` the ids (array<int>) and the decoded text follow.
    """
    path = model or default_model()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = model_at(path)
        counts, digests, back, all_ids, texts = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            raw = coder.encode(text or "")
            ids = np.frombuffer(raw, "<u4")
            decoded = coder.decode(ids.tolist())
            counts.append(len(ids))
            digests.append(hashlib.sha256(raw).hexdigest())
            back.append(hashlib.sha256(decoded.encode()).hexdigest())
            if keep_ids:
                all_ids.append(ids.astype(np.int32))
                texts.append(decoded)
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests), pa.array(back)]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            names += ["ids", "decoded"]
        return pa.record_batch(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_text(
        df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        run,
        schema + ", ids array<int>, decoded string" * keep_ids,
        after=lambda: model_at(path).memo.clear(),
    )
