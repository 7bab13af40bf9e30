"""Impact reports of a part that more depends on than a service's search would visit."""

from __future__ import annotations

import pytest

from lodestone.plans import graph_queries as G
from lodestone.plans import registry

from .compare import connect, same_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smallest tables, with the line items of every other order on one part: its orders alone are over 400, their customers lie behind them."""
    out = tmp_path_factory.mktemp("hub")
    con = connect(FOLDER)
    for name in ("region", "nation", "customer", "supplier", "part", "orders"):
        con.execute(f"COPY {name} TO '{out}/{name}.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN l_orderkey % 2 = 0 THEN 7 ELSE l_partkey END AS l_partkey) FROM lineitem) TO '{out}/lineitem.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("name", ["graph_impact", "graph_impact_stored", "graph_impact_files", "graph_impact_narrative", "graph_impact_tree"])
def test_all_that_depends_is_found(spark, folder, name):
    assert same_rows(spark, connect(folder), registry.queries()[name], registry.oracle_sql()[name], folder)


def test_reach_goes_beyond_the_services_limit(spark, folder):
    rows = G.impact_rows(spark, folder).groupBy("depth").count().collect()
    found = {r["depth"]: r["count"] for r in rows}
    assert found[1] > 400 and found[2] > 0
