"""All queries of the library by name, with their SQL where there is a form. Those without are compared by rows and tests."""

from __future__ import annotations

from knotwork.plans import entity_queries, graph_queries, record_queries

QUERIES = {}
ORACLES = {**graph_queries.O, **record_queries.O, **entity_queries.O}


def _shipped(f):
    def run(spark, sf_dir):
        from knotwork.session import ship_package

        ship_package(spark)
        return f(spark, sf_dir)

    return run


for _name, _f in {**graph_queries.Q, **record_queries.Q, **entity_queries.Q}.items():
    QUERIES[_name] = _shipped(_f)
