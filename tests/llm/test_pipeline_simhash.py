"""The pipeline's second stage goes by SimHash fingerprints first, then by shingles."""

from __future__ import annotations

import corpus_pipeline

from . import brute


def test_near_copies_by_fingerprint_and_by_shingles(spark, tmp_path):
    chorus = "over and out " * 60
    prose = [f"word{i}" for i in range(80)]
    edited = " ".join([*prose[:40], "other", *prose[41:]])
    texts = {1: chorus + "first", 2: chorus + "then another end of it all", 3: " ".join(prose), 4: edited, 5: "something else entirely"}
    assert len({brute.components({i: brute.fingerprint(texts[i]) for i in (1, 2)})[i] for i in (1, 2)}) == 1
    assert len({brute.components({i: brute.fingerprint(texts[i]) for i in (3, 4)})[i] for i in (3, 4)}) == 2
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == {1, 3, 5}
