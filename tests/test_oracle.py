"""The driver's correctness gate in miniature: every registered query vs its DuckDB oracle at sf0.001."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

from clickrank.plans.queries import NO_ORACLE, QUERIES

from .conftest import SF_SMALL
from .oracle_check import TABLES, digest

SQL = entry.oracle_sql()
SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
SLOW = {"als_grid", "scale_experiment", "partition_invariance"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_oracle_or_is_listed():
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) - set(SQL) == set(NO_ORACLE)


@pytest.mark.parametrize("name", sorted(n for n in SQL if n in QUERIES and n not in SLOW))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(SQL[name])
    spark_types = {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes}
    assert spark_types == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    res = con.execute(SQL[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 2
