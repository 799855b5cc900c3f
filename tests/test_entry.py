"""The driver contract."""

import importlib


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    out = entry.entry(spark)
    assert out.columns == ["id"] and out.count() > 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and all(callable(q) for q in queries.values())
    assert len([q for q in queries if q[0] in "vgitc"]) > 85
