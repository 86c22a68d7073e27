"""Every registered query on the smallest tables, and against its SQL where there is one."""

import pytest

from llm_cases import SMALL, tables  # noqa: F401  isort:skip

import __spark_entry__ as entry
from quillgrid.llm import queries as registered

QUERIES, SQL = registered.queries(), registered.oracle_sql()


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, tables, name):
    got = QUERIES[name](spark, SMALL)
    rel = tables.execute(SQL[name])
    order = sorted(c[0] for c in rel.description)
    assert sorted(got.columns) == order
    at = [[c[0] for c in rel.description].index(c) for c in order]
    want = sorted((tuple(r[k] for k in at) for r in rel.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op2_bm25_wand", "op4_best_fit_packing", "op6_html_text_density", "op13_collocations"}))
def test_one_row_per_document(spark, name):
    got = QUERIES[name](spark, SMALL)
    ids = sorted(r[0] for r in got.select("doc_id").collect())
    assert ids == sorted(r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect())
