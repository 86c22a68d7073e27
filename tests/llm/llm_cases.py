"""Fixtures and rows that the tests of this folder share."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SMALL = "/root/testdata/sf0.001"
#: Rows that every operator has to take: nulls, empty and blank texts, repeated rows, ties, a very long text.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (None, "one two three four"), (None, None),
       (7, "the same words here"), (8, "the same words here"), (9, "x" * 30_000), (10, "word " * 20_000), (11, "\0 é 漢字 🙂 ▁ <s>")]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from a list of ``(doc_id, text)``, with columns whose names clash with those of results."""
    def build(rows):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCUMENTS)
        for name in ("n_words", "n", "cls", "key", "found", "term", "length", "kept", "_row", "u", "hubs", "items", "_id", "_kept", "m", "row", "id", "any"):
            df = df.selectExpr("*", f"'x' as {name}")
        return df.repartition(3)
    return build


@pytest.fixture(scope="session")
def tables():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con
