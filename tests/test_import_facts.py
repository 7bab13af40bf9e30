"""Names of imports where a file's first symbols come late."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestone.plans import registry

from .compare import connect, same_rows

NAMES = ["join_imported_symbols", "join_import_edges", "join_resolve_names", "resolve_edges"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("late")
    late = "\n".join(["…"] * 450 + ["alpha", "beta", "gamma", "delta", "alpha"])
    texts = {1: "one\ntwo\nthree", 2: late, 3: "alpha\nbeta", 4: "alpha\n" + late}
    pq.write_table(pa.table({"doc_id": pa.array(list(texts), pa.int64()), "text": list(texts.values())}), base / "documents.parquet")
    return str(base)


@pytest.mark.parametrize("name", NAMES)
def test_late_symbols(spark, folder, name):
    assert same_rows(spark, connect(folder), registry.queries()[name], registry.oracle_sql()[name], folder)
