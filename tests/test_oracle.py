"""Every registered query against its SQL, and the shape of every plan."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL
from quillgrid.oracles import oracle_sql
from quillgrid.queries import queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = df.collect()
    rel = duck.execute(SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(names)
    want = [dict(zip(names, row)) for row in rel.fetchall()]
    order = sorted(names)
    assert sorted(tuple(r[c] for c in order) for r in got) == sorted(tuple(r[c] for c in order) for r in want)
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() == 1
