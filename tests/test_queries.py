"""Every registered query of the library against its SQL at the smallest size."""

from __future__ import annotations

import pytest

from lodestone.plans import registry

from .compare import connect, same_rows

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: The history has no row for these at this size, or the answer is a text.
MAY_BE_EMPTY = {"graph_compact_edges", "symbol_list", "graph_dependencies", "graph_related", "graph_neighbors"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert same_rows(spark, con, QUERIES[name], SQL[name], FOLDER) or name in MAY_BE_EMPTY
    else:
        assert QUERIES[name](spark, FOLDER).count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES) <= set(__spark_entry__.queries())
