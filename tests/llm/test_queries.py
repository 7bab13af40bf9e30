"""The registered queries: their SQL at the smallest size, and their columns."""

from __future__ import annotations

import pytest

from lodestone.llm import registry

from ..compare import connect, same_rows

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()
COLUMNS = {
    1: ["doc_id", "held_out", "score", "predicted"],
    3: ["query_id", "rank", "vec_id", "score"],
    4: ["doc_id", "fingerprint", "component_id"],
    5: ["page_id", "url", "text", "n_chars"],
    6: ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    7: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    8: ["doc_id", "n_words", "n_removed", "kept_sha256"],
    9: ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    10: ["page_id", "host", "path", "rule", "verdict"],
    11: ["vec_id", "n_links", "component_id", "kept"],
    12: ["item_id", "rank", "doc_id", "score"],
    13: ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_like_its_sql(spark, con, name):
    assert same_rows(spark, con, QUERIES[name], SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_whole_table_comes_back(spark, name):
    df = QUERIES[name](spark, FOLDER)
    number = int(name[2:].split("_")[0])
    if number in COLUMNS:
        assert df.columns == COLUMNS[number]
    table = "pages" if number in (5, 9, 10) else "embeddings" if number == 11 else "documents"
    if number not in (3, 12):
        assert df.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
