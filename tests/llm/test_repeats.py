"""Rows that share a doc_id, or have none, among near duplicates."""

from collections import Counter

import pytest
from llm_cases import docs  # noqa: F401

from quillgrid.llm import odd_sketch

LONG = " ".join(f"w{k}" for k in range(200))
ROWS = [(1, "a b c d"), (1, "a b c d"),                                     # repeated
        (5, "A b  c d"), (5, "a text of its own"),                          # a copy of 1, and none
        (7, "same words here now"), (7, "Same  words here now"),            # one class
        (9, LONG), (9, LONG + " more"), (10, LONG + " less"), (11, ""), (11, " "), (12, None), (13, "stands alone here")]
STAY = {1: 1, 5: 1, 7: 1, 9: 1, 11: 1, 12: 1, 13: 1}


@pytest.mark.parametrize("more, stay", [([], {}), ([(None, "a b c d"), (None, "no id at all"), (None, "no id at all"), (None, "")], {None: 2})])
def test_one_row_of_each_group_stays(docs, more, stay):
    got = odd_sketch.deduplicated(docs(ROWS + more)).collect()
    assert Counter(r.doc_id for r in got) == STAY | stay
    assert {r.text for r in got if r.doc_id == 5} == {"a text of its own"}
    assert {r.text for r in got if r.doc_id is None} == ({"no id at all", ""} if more else set())


def test_rows_without_id_are_no_common_key(docs, spark):
    """A class without id is looked for among rows without id once, not once for each of them."""
    rows = [(None, f"words that many rows share and one of its own {k}") for k in range(400)]
    df = docs(rows)
    sets = odd_sketch._sets(df, spark.createDataFrame(
        [(odd_sketch.name_of(odd_sketch.shingles(t.encode())), None) for _, t in rows], "cls binary, wanted_id long"))
    assert sets.count() == 400
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert "<=>" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert odd_sketch.deduplicated(docs(rows[:30])).count() == 30


def test_only_sets_that_a_pair_names_are_dealt_out(spark):
    sets = spark.createDataFrame([(b"a", [1, 2, 3]), (b"b", [1, 2, 3]), (b"c", [9]), (b"d", [1, 2, 3])], "cls binary, them array<long>")
    pairs = spark.createDataFrame([(b"a", b"b"), (b"a", b"c")], "u binary, v binary")
    found = odd_sketch.confirmed(pairs, sets)
    assert [(bytes(r.u), bytes(r.v)) for r in found.collect()] == [(b"a", b"b")]
    assert "LeftSemi" in found._jdf.queryExecution().executedPlan().toString()


def test_texts_stay_where_they_are(docs, monkeypatch):
    """Joins with texts take the ids to them, and beyond a bound give the same rows by dealing out the texts."""
    rows = ROWS + [(None, "a b c d e f"), (1, "a b c d e f g"), (77, None)]
    got = []
    for sent in (1 << 21, 0):
        monkeypatch.setattr(odd_sketch, "SENT", sent)
        df = odd_sketch.deduplicated(docs(rows))
        got.append(sorted(((r.doc_id, r.text) for r in df.collect()), key=str))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert ("LeftAnti" in plan) and ("strategy=broadcast" in plan) == (sent > 0)
    assert got[0] == got[1]
