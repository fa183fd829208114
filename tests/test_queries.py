"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import datetime
import decimal
import os

import pytest

import __spark_entry__ as entry
from tallyforge.plans import oracle, problems, queries

FOLDER = "/root/testdata/sf0.001"
CORE = {**queries.QUERIES, **problems.QUERIES}
SQL = {**oracle.ORACLE, **problems.ORACLE}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{file}')")
    return con


def plain(value):
    if isinstance(value, float | decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


def same(frame, result):
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(frame.columns)
    order = sorted(names)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in frame.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    same(CORE[name](spark, FOLDER), duck.execute(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL) - {"p1_paths", "p1_descendants"}))
def test_query_runs(spark, name):
    assert CORE[name](spark, FOLDER).count() > 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) >= set(CORE)
    assert entry.entry(spark).limit(1).count() == 1


def test_event_counts_are_conserved(spark):
    from tallyforge.runtime import table

    rows = CORE["code_counts_modifiers"](spark, FOLDER).agg({"event_count": "sum"}).first()[0]
    assert rows == table(spark, FOLDER, "med_events").count()


def test_pushdown_and_pruning(spark):
    plan = CORE["code_counts_modifiers"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<subject_id:bigint,code:string,modifier:string>" in plan
    assert "Expand" not in plan
    features = CORE["p3_found"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(time)" in features
