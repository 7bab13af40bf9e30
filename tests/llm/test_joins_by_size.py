"""No join is sent to all executors by an estimate: an explode makes more rows than Spark takes it for."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrameWriter

from lodestone.llm import common, nearcopies, simhash, substrings

TEXTS = [" ".join(f"w{(i * 7 + k) % 50}" for k in range(40)) + (" tail" if i % 3 else " Tail") for i in range(12)] * 2


@pytest.fixture
def planned(monkeypatch):
    """The plans of all tables that are written meanwhile."""
    seen, real = [], DataFrameWriter.parquet

    def parquet(self, *args, **kwargs):
        seen.append(plan(self._df))
        return real(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return seen


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [simhash.near_duplicates, simhash.keep_first, nearcopies.keep_first, substrings.remove, substrings.kept_words])
def test_joins_go_by_key(spark, planned, query):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    plans = [plan(query(docs)), *planned]
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastHashJoin" in p]


def test_the_sessions_own_settings_come_back(spark):
    key, unset = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    common.materialize(spark.range(3), "three")
    assert (spark.conf.get(key), spark.conf.get(unset, None)) == (before, None)
    with pytest.raises(Exception):
        common.materialize(spark.range(3).selectExpr("raise_error('no') as x"), "none")
    assert spark.conf.get(key) == before
