"""Registered text queries against their SQL, and the bare contract of the others."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_point
from tidetrace.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sql, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    cursor = sql.execute(ORACLE[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    expected = sorted(repr(tuple(r[i] for i in order)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == expected


def test_all_are_registered():
    names = entry_point.queries()
    assert set(QUERIES) < set(names) and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
