"""Every registered query of the reference-side operators runs, and equals its SQL."""

import math

import duckdb
import pytest

from millrace.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        return x if x is None or isinstance(x, (int, bool)) else str(x)

    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf, name):
    df = registry.QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows
    if name in registry.ORACLE_SQL:
        want = duck.execute(registry.ORACLE_SQL[name])
        columns = [d[0] for d in want.description]
        assert plain(df.columns, rows) == plain(columns, want.fetchall())


def test_entry_point_lists_all(sf, spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["branch", "shard", "n", "sum_k"]
