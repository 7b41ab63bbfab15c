import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry


def _norm(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(_norm, v)) if isinstance(v, list) else v if isinstance(v, (int, str, type(None))) else str(v)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def test_flagship(spark):
    assert entry.entry(spark).columns == ["l_returnflag", "count", "sum_l_quantity", "avg_l_extendedprice"]


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.core.queries())))
def test_query_against_sql(spark, sf, db, name):
    df = entry.queries()[name](spark, sf)
    got = sorted((tuple(_norm(v) for v in r) for r in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql:
        res = db.execute(sql)
        at = [[c[0] for c in res.description].index(c) for c in df.columns]
        assert got == sorted((tuple(_norm(r[i]) for i in at) for r in res.fetchall()), key=repr)


def test_core_does_without_llm():
    """Nothing outside the llm folder imports it."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for p in glob.glob(f"{root}/millrace/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in p:
            assert not re.search(r"\bllm\b", open(p).read()), p
