"""Every registered query against the SQL beside it, on DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(value):
    if isinstance(value, float):
        return repr(round(value, 9))
    return str(value)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_same_rows(spark, sf, duck, name):
    df = core.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(same(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(core.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(same(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_all_have_sql_or_are_of_the_training_operators():
    assert set(core.QUERIES) == set(core.ORACLE_SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())
