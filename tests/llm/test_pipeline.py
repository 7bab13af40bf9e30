"""The pipeline, stage by stage, against plain versions on a small corpus."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from lodestone.llm import pieces_bpe, quality, registry
from lodestone.llm.common import utf8  # noqa: F401  the operators' modules must import

from . import brute

WORDS = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."
    junk = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["###", "%%%"]) for _ in range(n))
    items = [(k, prose(25)) for k in range(6)]
    passage = prose(60)
    texts = {i: prose(rng.randint(20, 120)) if i % 5 else junk(rng.randint(20, 60)) for i in range(150)}
    for i in range(150, 170):
        texts[i] = texts[i - 149]  # exact copies
    for i in range(170, 190):
        texts[i] = f"{prose(40)}\n{passage} {prose(30)}"
    for i in range(190, 200):
        texts[i] = f"{prose(50)} {items[i % 6][1].upper()} {prose(50)}"
    texts[200], texts[201] = None, ""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 5 != 0), 0) for i in range(140)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, items


def test_stages_like_brute_force(spark, corpus):
    folder, texts, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = {i: t for i, t in texts.items() if model.score(quality.features((t or "").encode())) >= 0.7}
    assert {i for i in want if i < 140} == {i for i in range(140) if i % 5}
    stages = dict(corpus_pipeline.STAGES)
    out = stages["quality"](spark, docs, folder)
    assert out.columns == COLUMNS and {r.doc_id: r.text for r in out.collect()} == want

    roots = brute.components({i: brute.fingerprint(t) for i, t in want.items()})
    want = {i: t for i, t in want.items() if roots[i] == i}
    docs = stages["simhash"](spark, out, folder)
    assert docs.columns == COLUMNS and {r.doc_id: r.text for r in docs.collect()} == want
    assert not {i for i in want if 150 <= i < 170 and (i - 149) % 5}

    gone = brute.repeated_words(want)
    next_want = {}
    for i, t in want.items():
        if gone[i] and all(gone[i]):
            continue
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        next_want[i] = t if t is None else brute.without(t, spans, gone[i])
    want = next_want
    docs = stages["substrings"](spark, docs, folder)
    assert docs.columns == COLUMNS and {r.doc_id: r.text for r in docs.collect()} == want

    next_want = {}
    for i, t in want.items():
        n, hit, _ = brute.contamination(t, items)
        if n and sum(hit) > 0.8 * n:
            continue
        spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
        next_want[i] = t if t is None else brute.without(t, spans, hit)
    want = next_want
    docs = stages["decontaminate"](spark, docs, folder)
    assert docs.columns == COLUMNS
    rows = {r.doc_id: r for r in docs.collect()}
    assert {i: r.text for i, r in rows.items()} == want
    assert all(r.n_chars == len(r.text or "") for r in rows.values())

    library = sentencepiece.SentencePieceProcessor(model_file=pieces_bpe.default_model())
    ids = {i: library.encode(t or "", add_bos=True, add_eos=True) for i, t in want.items()}
    result = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect()}
    assert result == {i: (len(x), brute.sha(np.array(x, "<u4").tobytes())) for i, x in ids.items()}


def test_stages_of_empty_tables_and_clashing_columns(spark, corpus):
    folder, texts, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(12)
    odd = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "1 as score", "array(2) as spans", "'x' as digest", "7 as cell", "'y' as words", "3 as n_tokens", "4 as root", "5 as quality")
    for stage_docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, stage_docs, folder)
            if name != "sentencepiece":
                assert out.columns == odd.columns
                assert all((r.score, r.spans, r.digest, r.cell, r.words, r.root) == (1, [2], "x", 7, "y", 4) for r in out.collect())
            else:
                assert out.count() == stage_docs.count()


def test_intermediate_tables_are_released(spark, corpus):
    from lodestone.llm import common

    before = list(common.MADE)
    out = corpus_pipeline.run(spark, corpus[0])
    assert [t for t in common.MADE if not any(t is b for b in before)] == [out]


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline", *(q.__name__ for q in registry.QUERIES)} <= names
    assert {int(re.match(r"op(\d+)_", q.__name__)[1]) for q in registry.QUERIES} == set(range(1, 14))
