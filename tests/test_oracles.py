"""Every query with SQL gives what DuckDB says, value by value, on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest
from tests.conftest import SF_SMALL

from tessera.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in cursor.fetchall()), key=repr)
    assert got == want


def test_every_query_is_run_somewhere():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert sorted(set(QUERIES) - set(ORACLE_SQL)) == ["detect_ner_company", "gold_eval", "pseudonymize"]
