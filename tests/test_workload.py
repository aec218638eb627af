"""Every registered query against its SQL on the smallest tables."""

import datetime as dt

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("customer", "orders", "lineitem", "events"):
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, dt.datetime):
            v = v.date()
        return repr(v) if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def test_registry():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(SQL) - set(entry.LLM_SQL)))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.columns, df.collect()) == canonical(columns, cursor.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 2
