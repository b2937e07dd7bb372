"""Every query with an SQL twin gives its rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import kernels, stored

QUERIES, ORACLE_SQL = kernels.QUERIES | stored.QUERIES, kernels.ORACLE_SQL | stored.ORACLE_SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _rows(columns, rows):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(r[k] for k in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_twin(spark, duck, name):
    df = QUERIES[name](spark, SF)
    twin = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(twin.columns)
    assert _rows(df.columns, df.collect()) == _rows(twin.columns, twin.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_obj_text(spark):
    assert kernels.QUERIES["obj_text"](spark, SF).first()["obj"].startswith("v ")
