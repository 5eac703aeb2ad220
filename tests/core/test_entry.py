"""The entry points: the flagship query returns rows, and every query has its columns in its SQL too."""

import os

import pytest

import __spark_entry__
from gridloom.plans.registry import QUERIES, SQL

DATA = os.environ.get("TEST_DATA_DIR", "/root/testdata")


def test_entry_returns_rows(spark, monkeypatch):
    monkeypatch.setenv("ENTRY_DATA_DIR", f"{DATA}/sf0.001")
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) > 100 and all(r.path.split(" > ")[-1] == r.node and r.hop >= 1 for r in rows)


def test_registered_queries_and_sql():
    assert set(SQL) <= set(QUERIES) and set(QUERIES) <= set(__spark_entry__.queries())


NEW = [n for n, f in QUERIES.items() if n in SQL and f.__module__ in ("gridloom.plans.store_queries", "gridloom.plans.schema_queries")]


def test_all_modules_are_registered():
    assert len(NEW) > 25


@pytest.mark.parametrize("name", ["gra01_propagate_all_locations", "gra19_history", "evt07_replacements", "txt04_section_headers", *NEW])
def test_query_equals_its_sql(spark, name):
    import duckdb

    folder = f"{DATA}/sf0.001"
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, folder).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
