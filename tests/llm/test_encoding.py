"""Piece encoding, token counts, WARC, top-k search."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
import sentencepiece

from lodestone.llm import pieces_bpe, tokencounts, topk, warc

from . import brute

MODEL = pieces_bpe.default_model()
ODD = ["", " ", "  ", "a", " a", "a ", "▁", "▁▁a", "a▁b", "\n", "a\n\nb", "\t", "日本語 🙂", "<s>", "</s>", "<0x0A>", "\x00", "x" * 3000, "the " * 500, "    deep   indent", "e\u0301 é", "\u3000 x\u00a0y", "<unk>"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def random_texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    alphabet = list("abcdehinorst.,!?'\"-ABC012 é日🙂▁\n\t") + ["  ", "the", "ing", " th", "tion"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_encode_like_the_library(library):
    coder = pieces_bpe.model_at(MODEL)
    for text in ODD + random_texts(1, 4000):
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True), text


def test_prefix_table_like_merging():
    coder = pieces_bpe.model_at(MODEL)
    rng = random.Random(2)
    for _ in range(2000):
        chunk = "▁" * rng.choice([0, 1, 1, 2, 3, 15, 16, 17, 40]) + "".join(rng.choice("aehinorst🙂é\x01𐍈") for _ in range(rng.randint(0, 25)))
        want = []
        for piece in coder.merged(chunk):
            want += [coder.rank[piece][1]] if piece in coder.rank else [coder.bytes_id[b] for b in piece.encode()]
        assert (coder.chunk_ids(chunk) if chunk else []) == want


def test_only_runs_of_marks_are_merged_step_by_step(monkeypatch):
    coder = pieces_bpe.PieceBpe(open(MODEL, "rb").read())
    coder.table("▁warm")
    stepped, merged = [], coder.merged
    monkeypatch.setattr(coder, "compatible", lambda left, right: merged(coder.pieces[left][0] + coder.pieces[right][0]) == [coder.pieces[left][0], coder.pieces[right][0]])
    monkeypatch.setattr(coder, "merged", lambda text: stepped.append(text) or merged(text))
    for text in ODD + random_texts(7, 500):
        coder.encode(text)
    assert any(stepped) and all(set(t) <= {"▁"} for t in stepped)


def test_decode_like_the_library(library):
    coder = pieces_bpe.model_at(MODEL)
    for text in ODD:
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert coder.decode(ids) == library.decode(ids)


def test_encode_rows(spark, library):
    rows = [(i, t, "x") for i, t in enumerate([None, *ODD])] + [(None, "null id", "x"), (5, "again", "y"), (5, "again", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    want = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((str(i), len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(library.decode(ids))))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces_bpe.encode_documents(df).collect()]
    assert sorted(got) == sorted(want)
    kept = pieces_bpe.encode_documents(df, keep_ids=True).where("doc_id = 2").first()
    assert list(kept.ids) == library.encode(ODD[1], add_bos=True, add_eos=True) and kept.decoded == ODD[1]
    assert pieces_bpe.encode_documents(df.limit(0)).count() == 0


def tokenizer():
    return tokencounts.tokenizer_at(*tokencounts.default_tokenizer())


def check_counted(counted, own):
    fresh = tokencounts.CountedText(counted.text, own)
    assert counted.ends.tolist() == fresh.ends.tolist() and counted.counts.tolist() == fresh.counts.tolist()
    assert counted.tree.total == len(own.encoding.encode_ordinary(counted.text)) == sum(counted.tree.levels[0])
    assert counted.blocks.sum() == len(counted.ends) and len(counted.blocks) == len(counted.tree.levels[0])
    edges = np.concatenate([[0], np.cumsum(counted.blocks)])
    assert [int(counted.counts[a:b].sum()) for a, b in zip(edges, edges[1:], strict=False)] == counted.tree.levels[0].tolist()
    for below, above in zip(counted.tree.levels, counted.tree.levels[1:], strict=False):
        assert tokencounts.pair_sums(below).tolist() == above.tolist()


@pytest.mark.parametrize("seed", range(3))
def test_edits_like_counting_anew(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(tokencounts, "BLOCK", 4)
    parts = ["a", "Z", "7", " ", "  ", "\n", " \n", "'ll", "'", "é", "!", "??", "日", "abc de", " 12", "\t"]
    make = lambda n: "".join(rng.choice(parts) for _ in range(rng.randint(0, n)))
    own = tokenizer()
    for _ in range(300):
        counted = tokencounts.CountedText(make(60), own)
        for _ in range(3):
            places = sorted(rng.randint(0, len(counted.text)) for _ in range(2 * rng.randint(0, 5)))
            edits = [(a, b, make(3)) for a, b in zip(places[::2], places[1::2], strict=True)]
            text = counted.text
            for a, b, new in reversed(edits):
                text = text[:a] + new + text[b:]
            counted.edit_all(edits)
            assert counted.text == text
            check_counted(counted, own)
            counted = tokencounts.CountedText.restored(text, own, *counted.stored()[2:])
            check_counted(counted, own)


def test_edits_touch_little():
    counted = tokencounts.CountedText("some words here " * 5000, tokenizer())
    counted.edit(40_000, 40_003, "new")
    assert 0 < counted.encoded < 10
    for low, high in ((100, 9000), (3, 5), (64, 128), (0, 15_000)):
        assert counted.range_sum(low, high) == int(counted.counts[low:high].sum())


def test_many_edits_cost_less_than_counting_anew():
    import time

    rng = random.Random(4)
    text = " ".join(f"{rng.choice(['plain', 'words', 'between'])} {rng.choice(['them', 'stay'])} as they are {rng.randint(10**8, 10**9)} or so, {rng.choice(['in', 'on'])} this text of many edited numbers and words that stay as they were" for _ in range(16_000))
    own = tokenizer()
    counted = tokencounts.CountedText(text, own)
    edits = tokencounts.redactions(text)
    assert len(text) > 1_500_000 and len(edits) == 16_000
    began = time.process_time()
    counted.edit_all(edits)
    edited = time.process_time() - began
    began = time.process_time()
    fresh = tokencounts.CountedText(counted.text, own)
    anew = time.process_time() - began
    assert counted.counts.tolist() == fresh.counts.tolist() and counted.encoded < 10 * len(edits)
    print(f"edits {edited:.2f} s, anew {anew:.2f} s")
    assert edited < anew


def test_overlapping_edits_are_refused():
    with pytest.raises(ValueError, match="overlap"):
        tokencounts.CountedText("abcdef", tokenizer()).edit_all([(0, 3, ""), (2, 4, "")])
    with pytest.raises(ValueError, match="beyond"):
        tokencounts.CountedText("abcdef", tokenizer()).edit_all([(5, 7, "")])


def test_token_counts_of_repeated_and_null_ids(spark):
    rows = [(1, "call 12345678", 0), (1, "call 12345678", 0), (1, "mail a@b.cd", 0), (None, "x@y.zz", 0), (None, "x@y.zz", 0), (None, None, 0), (2, "no edit", 0)]
    got = tokencounts.token_counts(spark.createDataFrame(rows, "doc_id long, text string, digest int")).collect()
    count = lambda t: len(tokenizer().encoding.encode_ordinary(t))
    want = []
    for i, text, _ in rows:
        edited, n = tokencounts.EDITS.subn(lambda m: tokencounts.PLACEHOLDERS[m.lastgroup], text or "")
        want.append((str(i), count(text or ""), n, count(edited)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_edits, r.n_tokens_after) for r in got) == sorted(want)


def test_token_count_rows(spark):
    texts = [None, "", "mail a.b@c.org now", "call 12345678 or 1234567, x@y.zz!", "plain words", "y" * 20_000]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    rows = {r.doc_id: r for r in tokencounts.token_counts(df).collect()}
    count = lambda t: len(tokenizer().encoding.encode_ordinary(t))
    for i, text in enumerate(texts):
        edited = tokencounts.EDITS.sub(lambda m: tokencounts.PLACEHOLDERS[m.lastgroup], text or "")
        assert (rows[i].n_tokens, rows[i].n_tokens_after) == (count(text or ""), count(edited))
    assert rows[3].n_edits == 3 and rows[4].n_encoded_again == 0
    assert tokencounts.token_counts(df.limit(0)).count() == 0


def digest(html) -> str:
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


PAGES = [(1, "http://a/", "same"), (2, "http://b/\r\nx", "same"), (3, None, None), (4, "u", ""), (5, "u", "l1\r\n\r\nWARC/1.1\r\n\r\nl2\n"), (6, "u", "é" * 5000), (7, "u", "same"), (8, "u", "\n\n"), (9, "u", "é" * 5000 + "x"), (10, "u", "\r\n\r\n" * 700)]


def records_in(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(fields, block) of the records of a WARC file, cut as the standard says."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        assert version == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines)
        assert len(fields) == len(lines)
        stop = end + 4 + int(fields["Content-Length"])
        assert data[stop : stop + 4] == b"\r\n\r\n"
        out.append((fields, data[end + 4 : stop]))
        at = stop + 4
    return out


def check_archive(path, payloads, want):
    """The files of an archive, read without the module."""
    found, names = {}, [f for f in Path(path).iterdir() if not f.name.startswith((".", "_"))]
    assert names and all(f.name.endswith(".warc.gz") for f in names)
    heads = []
    for file in names:
        origin = None
        for fields, block in records_in(gzip.decompress(file.read_bytes())):
            assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Target-URI"} <= set(fields)
            assert re.fullmatch(r"<[a-z]+:\S+>", fields["WARC-Record-ID"]) and datetime.fromisoformat(fields["WARC-Date"]).tzinfo
            heads.append(fields)
            if fields["WARC-Type"] == "continuation":
                assert fields["WARC-Segment-Origin-ID"] == origin["WARC-Record-ID"] and fields["WARC-Target-URI"] == origin["WARC-Target-URI"]
                found[origin["WARC-Record-ID"]].append((int(fields["WARC-Segment-Number"]), block))
                if "WARC-Segment-Total-Length" in fields:
                    assert int(fields["WARC-Segment-Total-Length"]) == sum(len(b) for _, b in found[origin["WARC-Record-ID"]])
            else:
                origin = fields
                found[fields["WARC-Record-ID"]] = [(1, block)]
    assert len({h["WARC-Record-ID"] for h in heads}) == len(heads)
    firsts = {h["WARC-Record-ID"]: h for h in heads if h["WARC-Type"] != "continuation"}
    assert len(firsts) == len(payloads)
    for name, head in firsts.items():
        key, parts = int(name.rstrip(">").rpartition(":")[2]), found[name]
        assert [n for n, _ in parts] == list(range(1, len(parts) + 1)) and head["WARC-Type"] == want[key][2]
        assert head["WARC-Payload-Digest"] == f"sha1:{want[key][1]}"
        if head["WARC-Type"] == "revisit":
            assert parts == [(1, b"")] and "revisit/identical-payload-digest" in head["WARC-Profile"]
            referent = firsts[head["WARC-Refers-To"]]
            assert referent["WARC-Type"] == "response" and referent["WARC-Payload-Digest"] == head["WARC-Payload-Digest"]
        else:
            status, body = b"".join(b for _, b in parts).split(b"\r\n\r\n", 1)
            assert status.startswith(b"HTTP/1.1 200") and body == payloads[key]


def test_payload_of_several_default_chunks(spark, tmp_path):
    long = "".join(f"{k} zeile é\r\n\r\nWARC/1.1\r\n" for k in range(150_000))
    df = spark.createDataFrame([(1, "u", long), (2, None, "x"), (3, "v", long), (4, "w", long[:-1])], "page_id long, url string, html string")
    table = warc.chunk_table(df).cache()
    sizes = [len(r.payload) for r in table.orderBy("page_id", "chunk").where("page_id = 1").collect()]
    assert len(sizes) > 3 and set(sizes[:-1]) == {1 << 20} and sum(sizes) == len(long.encode())
    warc.write(table, warc.typed(table), str(tmp_path / "w"))
    want = {1: (0, digest(long), "revisit"), 2: (0, digest("x"), "response"), 3: (0, digest(long), "response"), 4: (0, digest(long[:-1]), "response")}
    check_archive(str(tmp_path / "w"), {r.page_id: r.html.encode() for r in df.collect()}, want)
    rows = {r.page_id: (r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.archive(df).collect()}
    assert rows == {i: (len(h.encode()), digest(h), 3 if i == 1 else None) for i, _, h in df.collect()}


@pytest.mark.parametrize("chunk_bytes", [7, 1000, 1 << 20])
def test_archive_round_trip(spark, chunk_bytes, tmp_path):
    df = spark.createDataFrame([(*p, "e") for p in PAGES], "page_id long, url string, html string, record_type string").repartition(3)
    rows = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive(df, chunk_bytes).collect()}
    last = {}
    for i, _, html in PAGES:
        last[digest(html)] = i
    want = {i: (len((h or "").encode()), digest(h), "response" if last[digest(h)] == i else "revisit", None if last[digest(h)] == i else last[digest(h)]) for i, _, h in PAGES}
    assert rows == want
    path = str(tmp_path / "w")
    table = warc.chunk_table(df, chunk_bytes)
    assert all(len(r.payload) <= chunk_bytes for r in table.collect())
    warc.write(table, warc.typed(table), path)
    check_archive(path, {i: (h or "").encode() for i, _, h in PAGES}, want)
    chunks: dict[int, list] = {}
    for r in warc.read(spark, path).where("record_type = 'response'").collect():
        assert len(r.payload) <= max(chunk_bytes, 1)
        chunks.setdefault(r.page_id, []).append((r.chunk, bytes(r.payload)))
    texts = {i: b"".join(b for _, b in sorted(parts)).decode() for i, parts in chunks.items()}
    assert texts == {i: h or "" for i, _, h in PAGES if want[i][2] == "response"}


def test_archive_defined_cases(spark):
    df = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (1, "u", "y"), (None, "u", "x"), (None, "u", "z")], "page_id long, url string, html string")
    rows = sorted((str(r.page_id), r.payload_digest == digest("x"), r.record_type, r.refers_to or 0) for r in warc.archive(df).collect())
    assert rows == [("1", False, "response", 0), ("1", True, "response", 0), ("1", True, "response", 0), ("None", False, "response", 0), ("None", True, "revisit", 1)]
    assert warc.archive(df.limit(0)).count() == 0
    small = {r.page_id: r.record_type for r in warc.archive(df.limit(1).union(spark.createDataFrame([(2, "u", "x")], df.schema)), min_bytes=2).collect()}
    assert small == {1: "response", 2: "response"}


def brute_top_k(rows, k=10):
    out = []
    good = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, a in good:
        if q % 100:
            continue
        scored = sorted((-int(a @ b), i) for i, b in good if i != q and len(a) == len(b))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(("n", "dim", "spread"), [(900, 24, 1.0), (500, 64, 0.01), (8, 3, 1.0)])
def test_top_k_like_brute_force(spark, n, dim, spread):
    rng = np.random.default_rng(n)
    rows = [(i, (rng.normal(size=dim) * spread + 1).astype(np.float32).tolist()) for i in range(n)]
    rows[3] = (3, rows[4][1])
    rows += [(n + 100 - n % 100, None), (n + 1, [float("nan")] * dim), (n + 2, [1.0, None] + [0.0] * (dim - 2)), (None, [1.0] * dim), (n + 3, [float("inf")] * dim), (n + 200 - n % 100, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df).collect())
    assert got == brute_top_k(rows)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_many_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=1 + i % 5).astype(np.float32).tolist()) for i in range(600)] + [(7, [0.5, 0.5])] * 200
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, shard_numbers=300).collect())
    assert got == brute_top_k(rows)


def test_top_k_ties_and_hot_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(1000 + i, [0.5, float(i % 7), 1.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, shard_numbers=90).collect())
    assert got == brute_top_k(rows)


@pytest.mark.parametrize(
    ("more", "why"),
    [
        (b"\x1a\x02\x20\x01", "keep all spaces"),
        (b"\x1a\x02\x18\x00", "put a space before"),
        (b"\x1a\x03\x12\x01a", "rewrites characters"),
        (b"\x2a\x03\x12\x01a", "rewrites characters"),
        (b"\x12\x02\x18\x01", "isn't a BPE model"),
        (b"\x0a\x05\x0a\x01a\x18\x04", "users defined"),
    ],
)
def test_models_encoded_otherwise_are_refused(more, why):
    data = open(MODEL, "rb").read()
    assert pieces_bpe.load_model(data)
    with pytest.raises(ValueError, match=why):
        pieces_bpe.load_model(data + more)
