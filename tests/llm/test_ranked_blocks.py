"""Blocks of the ranked index: few in a file, as many in every shard, numbered by the terms that are asked."""

from __future__ import annotations

import glob

import pyarrow as pa
import pyarrow.parquet as pq

from lodestone.llm import ranked


def test_a_file_holds_few_blocks_and_shards_are_even(spark, monkeypatch):
    written, real, dealt = [], ranked.materialize, []

    def materialize(df, label, **options):
        out = real(df, label, **options)
        if label == "blocks":
            written.extend(pq.ParquetFile(f).metadata.num_rows for f in glob.glob(out.lodestone_path.removeprefix("file://") + "/*.parquet"))
        return out

    def search_index(index, items, k, shard_postings):
        frame, by_id = type(index), type(index).repartitionById

        def repartition(self, shards, column):
            dealt.extend(r["count"] for r in self.where("not is_item").groupBy(column).count().collect())
            return by_id(self, shards, column)

        monkeypatch.setattr(frame, "repartitionById", repartition)
        return searched(index, items, k, shard_postings)

    searched = ranked.search_index
    monkeypatch.setattr(ranked, "materialize", materialize)
    monkeypatch.setattr(ranked, "search_index", search_index)
    docs = spark.createDataFrame([(i, f"w{i % 9} w{i % 7} common") for i in range(400)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([("q", "w3 common")], "item_id string, text string")
    assert ranked.search(docs, items, block_bytes=400, shard_postings=240).count() == 20
    assert sum(written) > 12 and max(written) <= 4
    assert len(dealt) == 5 and max(dealt) - min(dealt) <= 1


def test_a_block_numbers_what_is_asked():
    column = pa.array([[b"a", b"b", b"c"], [b"c", b"d"]], pa.list_(pa.binary()))
    one = b"\1\0\0\0\0\0\0\0"
    block = ranked.Block({"ids": one, "lengths": one, "ends": one * 2, "docs": b"\0" * 8, "counts": b"\1\0\0\0" * 2, "terms": column[1].values}, 1, 1)
    assert block.number == {}
    block.meet(pa.array([b"d", b"x", b"a"], pa.binary()))
    assert block.number == {b"d": 1}
