"""All queries of the library over the test tables, each with its SQL counterpart."""

from __future__ import annotations

from ..operators.persist import ship
from . import code_queries, extract_queries, graph_queries, history_queries
from .base import ORACLES, QUERIES

MODULES = (history_queries, code_queries, graph_queries, extract_queries)


def queries() -> dict:
    def shipped(query):
        def run(spark, sf_dir):
            ship(spark)
            return query(spark, sf_dir)

        return run

    return {name: shipped(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict:
    return dict(ORACLES)


def flagship(spark, sf_dir):
    """Hybrid search over symbols and units."""
    return queries()["hybrid_search"](spark, sf_dir)
