from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import MIDDLE
from quillgrid.operators import words
from quillgrid.queries import documents
from quillgrid.sources.documents import document_lines, read_documents

TEXTS = ["a b  a", "", " lead", "trail ", "Ä ä ß a", "one\ntwo one", "\n", "x\n\ny x"]


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _counts(df):
    return {r.word: r.n for r in df.collect()}


def _expected(texts):
    return Counter(w for t in texts for line in t.split("\n") for w in line.split(" "))


def _plans(docs):
    lines = document_lines(docs)
    return {
        "one round": words.word_count(docs),
        "one round, lines": words.word_count(lines),
        "salted": words.salted(lines, 4, seed=3),
        "salted, one group": words.salted(lines, 1),
        "on the fly": words.salted_on_the_fly(lines, 5),
        "partition": words.by_partition(lines),
    }


@pytest.mark.parametrize("texts", [TEXTS, [""], ["same same"] * 5])
def test_all_plans_agree(spark, texts):
    want = _expected(texts)
    for name, df in _plans(_docs(spark, texts)).items():
        assert _counts(df) == want, name


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab \n", max_size=12), min_size=1, max_size=6))
def test_all_plans_agree_on_any_text(spark, texts):
    want = _expected(texts)
    for name, df in _plans(_docs(spark, texts)).items():
        assert _counts(df) == want, name


def test_per_document(spark):
    got = words.per_document(document_lines(_docs(spark, TEXTS))).collect()
    want = {(d, k, w, n) for d, t in enumerate(TEXTS) for k, line in enumerate(t.split("\n"))
            for w, n in Counter(line.split(" ")).items()}
    assert {(r.doc_id, r.line_no, r.word, r.n) for r in got} == want and len(got) == len(want)


def test_documents_with_one_id_stay_apart(spark):
    docs = spark.createDataFrame([(1, "a a"), (1, "a")], "doc_id long, text string")
    assert sorted(r.n for r in words.per_document(docs).collect()) == [1, 2]


def test_per_document_needs_no_shuffle(spark):
    plan = words.per_document(document_lines(_docs(spark, TEXTS)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_salts_stay_in_range_and_repeat(spark):
    docs = document_lines(_docs(spark, TEXTS))
    first = words.per_document_salted(docs, 3).collect()
    again = words.per_document_salted(docs.repartition(5), 3).collect()
    assert {r.salt for r in first} <= {0, 1, 2} and sorted(first) == sorted(again)
    with pytest.raises(ValueError):
        words.per_document_salted(docs, 0)


def test_no_documents(spark):
    docs = _docs(spark, TEXTS).filter("false")
    assert words.average_word_length(docs).first()[0] is None
    assert words.distinct_words(docs).first()[0] == 0
    assert words.word_count(docs).count() == words.per_document(docs).count() == 0


def test_golden_numbers(spark):
    docs = documents(spark, MIDDLE)
    counts = words.word_count(docs)
    assert document_lines(docs).count() == 9344
    assert counts.agg(F.sum("n")).first()[0] == 390171
    assert counts.orderBy(F.desc("n")).first() == ("the", 11605)
    assert words.distinct_words(docs).first()[0] == 93796
    assert words.average_word_length(docs).first()[0] == 7.77705872318649


def test_documents_from_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("b a\n\na  a\n")
    docs = read_documents(spark, str(tmp_path), partitions=3)
    assert docs.rdd.getNumPartitions() == 3
    assert docs.select("doc_id").distinct().count() == 3
    assert _counts(words.by_partition(docs)) == {"a": 3, "b": 1, "": 2}
    assert words.count_documents(docs).first()[0] == 3
