"""A query of the extraction gets what it reads, and nothing else is found or stored for it; what was shuffled for a stored table goes."""

from __future__ import annotations

import time
from pathlib import Path

import pytest

from lodestone.operators import persist
from lodestone.plans import extract_queries as Q
from lodestone.sources import extract, outline

FOLDER = "/root/testdata/sf0.001"
ODD = "const a = f(), B = () => <div/>; class X extends Y { run(a) { go(); } constructor() {} static h(): void; }\ninterface I { m(): void }\nconst o = { p() { q() } };\nexport { z } from './z'; @d() function g() {}"


@pytest.fixture(scope="module")
def files(spark):
    odd = spark.createDataFrame([(f"odd{k}", f"src/odd{k}", k, ODD) for k in ("typescript", "javascript", "rust", "python", "other")], "file_id string, path string, language string, text string")
    return Q.source_files(spark, FOLDER).select(odd.columns).limit(300).unionByName(odd).cache()


@pytest.mark.parametrize("wanted", [("parts",), ("code",), ("statements",), ("code", "parts", "statements")])
def test_the_same_is_found_alone(files, wanted):
    whole = {r.file_id: r for r in extract.file_rows(files).collect()}
    alone = extract.file_rows(files, wanted=wanted)
    assert alone.columns == ["file_id", "path", "language", *wanted]
    rows = alone.collect()
    assert len(rows) == len(whole) and all(r[c] == whole[r.file_id][c] for r in rows for c in alone.columns)


def test_code_alone_makes_no_declarations(monkeypatch):
    whole = outline.ecma(ODD)[1]
    monkeypatch.setattr(outline, "part", None)
    assert outline.code_of(outline.ecma, "typescript", ODD) == whole != ODD


def shuffled(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (blocks.apply(i).getName() for i in range(blocks.size())) if n.startswith("shuffle_") and n.endswith(".data")}


def test_shuffles_behind_a_stored_table_go(spark):
    before = shuffled(spark)
    rows = persist.persisted(spark.range(1000).selectExpr("id % 7 as k", "id as v").repartition(3, "k"), "dealt")
    assert len(rows.collect()) == 1000
    for _ in range(50):
        if not shuffled(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffled(spark) - before


def test_a_result_outlives_what_it_was_made_from(spark):
    made = []

    def make():
        rows = persist.persisted(spark.range(5), "on-the-way")
        made.extend(Path(f.removeprefix("file://")) for f in rows.inputFiles())
        return rows.where("id > 2")

    with persist.scratch():
        out = persist.result(make, "kept")
        assert out.count() == 2
        assert made and not any(f.exists() for f in made)
        path = Path(out.inputFiles()[0].removeprefix("file://"))
        assert path.exists()
    assert not path.exists()  # it goes with the scratch around it
