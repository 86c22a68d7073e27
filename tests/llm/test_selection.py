"""Decontamination, near duplicates and the ordinal models, against plain versions and held-out labels."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import ODD, SMALL, docs, tables  # noqa: F401

from quillgrid.llm import components, decontaminate, odd_sketch, ordinal, quality, toxicity
from quillgrid.llm.text import LOWER, UPPER

LOW = str.maketrans(UPPER, LOWER)
ITEMS = "item_id long, text string"


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def _contamination(rows, items, size=13):
    windows = defaultdict(set)
    for item_id, text in items:
        w = _words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k:k + size])].add(item_id)
    out = []
    for doc_id, text in rows:
        w, hit, ids = _words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(w[k:k + n])] - {None}
        listed = ",".join(sorted(map(str, ids)))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


LONG_ITEM = " ".join(f"w{k}" for k in range(30))
CASES = [*ODD, (20, f"before {LONG_ITEM} after"), (21, "W3, w4 w5; w6 w7 w8 w9 w10 w11 w12 w13 W14 w15!"), (22, "w3 w4 w5 w6 w7"),
         (23, "short item"), (24, "a Short--ITEM and short item " + "pad " * 60), (25, "same\nitem text"), (26, LONG_ITEM * 2)]
ITEM_ROWS = [(1, LONG_ITEM), (2, "Short item"), (3, None), (4, "..."), (5, "same item text"), (15, "same item text"), (None, "word word word"),
             (1, "short ITEM")]


@pytest.mark.parametrize("item_bytes", [decontaminate.ITEM_BYTES, 60])
def test_contamination(docs, spark, item_bytes):
    got = decontaminate.contamination(docs(CASES), spark.createDataFrame(ITEM_ROWS, ITEMS), item_bytes=item_bytes).collect()
    assert Counter(map(tuple, got)) == Counter(_contamination(CASES, ITEM_ROWS))


def test_clean_documents_stay_as_they_are(docs, spark):
    df, items = docs(CASES), spark.createDataFrame(ITEM_ROWS, ITEMS)
    dirty = {r[0] for r in _contamination(CASES, ITEM_ROWS) if r[5]}
    kept = decontaminate.clean(df, items)
    assert kept.columns == df.columns
    assert Counter(map(tuple, kept.collect())) == Counter(tuple(r) for r in df.collect() if r.doc_id not in dirty)


def test_many_items_are_scanned_by_one_small_automaton_after_the_other(docs, spark, monkeypatch):
    df, items = docs(CASES), spark.createDataFrame(ITEM_ROWS, ITEMS)
    dirty = {r[0] for r in _contamination(CASES, ITEM_ROWS) if r[5]}
    kept = decontaminate.clean(df, items, item_bytes=60)
    assert kept.columns == df.columns
    assert Counter(map(tuple, kept.collect())) == Counter(tuple(r) for r in df.collect() if r.doc_id not in dirty)
    text = " ".join(f"word{k % 5000}x{k % 7}" for k in range(20_000)).encode()
    *_, machine = decontaminate.automaton(((1, text),), 13)
    assert machine.get_stats()["total_size"] < 150 * len(text)       # of any length, few letters for each word


def test_spans_are_places_in_the_original(docs, spark):
    text = "Été -- W3, w4 w5; w6 w7 w8 w9 w10 w11 w12 w13 W14 w15! fin"
    got = decontaminate.spans(docs([(1, text)]), spark.createDataFrame(ITEM_ROWS, ITEMS)).collect()
    assert [text[r.start:r.end] for r in got] == ["W3, w4 w5; w6 w7 w8 w9 w10 w11 w12 w13 W14 w15"]


def test_nothing_to_find(docs, spark):
    items = spark.createDataFrame(ITEM_ROWS, ITEMS)
    assert decontaminate.contamination(docs(ODD).limit(0), items).collect() == []
    got = decontaminate.contamination(docs(CASES), items.limit(0)).collect()
    assert not any(r.contaminated or r.n_hit for r in got) and len(got) == len(CASES)


def _near(rows):
    sets = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets.append({tuple(w[k:k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if comp[a] != comp[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    old, new = comp[a], comp[b]
                    comp = [new if c == old else c for c in comp]
                    changed = True
    out = []
    for k, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[k] and rows[j][0] is not None]
        least = (min(ids) if ids else None) if sets[k] else doc_id
        out.append((doc_id, len(sets[k]), least, doc_id == least))
    return out


def _copies():
    """A chain of edits, a crowd of copies around one text, a shared passage, and exact copies."""
    draw = np.random.default_rng(4)
    word = lambda: "".join(draw.choice(list("abcdefgh"), 5))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows, text = [], list(base)
    for k in range(25):
        text[draw.integers(len(text))] = word()
        rows.append((100 + k, " ".join(text)))
    for k in range(60):
        own = list(base)
        for at in draw.integers(0, len(own), draw.integers(0, 7)):
            own[at] = word()
        rows.append((300 - k, " ".join(own)))
    rows += [(400 + k, " ".join(passage + [word() for _ in range(30)])) for k in range(20)]
    return rows + [(500 + k, " ".join(passage)) for k in range(10)] + ODD


@pytest.mark.parametrize("hubs", [odd_sketch.HUBS, (1, 2)])
def test_near_duplicates(docs, monkeypatch, hubs):
    monkeypatch.setattr(odd_sketch, "HUBS", hubs)
    rows = _copies()
    assert Counter(map(tuple, odd_sketch.near_duplicates(docs(rows)).collect())) == Counter(_near(rows))


def test_one_document_of_each_group_stays(docs):
    rows = _copies()
    df = docs(rows)
    kept = odd_sketch.deduplicated(df)
    want = {(i, n, c, k) for i, n, c, k in _near(rows) if k}
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in want)


def test_no_rows_no_groups(docs):
    assert odd_sketch.near_duplicates(docs(ODD).limit(0)).collect() == []
    assert odd_sketch.deduplicated(docs(ODD).limit(0)).collect() == []


def test_bitmaps_never_rule_out_a_link():
    draw = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(draw.integers(0, 1 << 60, draw.integers(1, 900), np.uint64))
        n = draw.integers(0, len(a) // 6 + 1)
        b = np.unique(np.concatenate([a[n:], draw.integers(0, 1 << 60, n // 2, np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 85 * (len(a) + len(b) - common):
            x, y = (odd_sketch.parity(odd_sketch.mixed(s), odd_sketch.ALL_BITS).view(np.uint64) for s in (a, b))
            assert 185 * int(np.bitwise_count(x ^ y).sum()) <= 15 * (len(a) + len(b))


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 130)] + [(129, 200), (7, 7)]
    got = {r.node: r.root for r in components.roots(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {k: 100 for k in [*range(101, 130), 200]}
    assert components.roots(spark.createDataFrame([], "u long, v long")).collect() == []


def test_cumulative_link_recovers_ordered_grades():
    draw = np.random.default_rng(6)
    truth = draw.normal(0, 2, 40)
    slots = [np.sort(draw.choice(40, 8, replace=False)) for _ in range(3000)]
    values = [np.ones(8, np.float32)] * 3000
    score = np.array([truth[s].sum() for s in slots]) + draw.logistic(0, 1, 3000)
    grades = np.digitize(score, [-4, 1, 5])
    model = ordinal.fit(slots[:2000], values[:2000], grades[:2000], 4, dimensions=40, sparse=0)
    assert (np.diff(model.thresholds) > 0).all()
    expected = np.array([model.above(s, v).sum() for s, v in zip(slots[2000:], values)])
    assert np.corrcoef(expected, grades[2000:])[0, 1] > 0.85
    assert all((np.diff(model.above(s, v)) <= 0).all() for s, v in zip(slots, values))


def _held_out(spark, module, judged, wanted):
    base = "/root/testdata/sf0.1"
    df, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = module.model(df, labels.filter("doc_id % 3 <> 0"))
    got = judged(df.join(labels.filter("doc_id % 3 = 0").select("doc_id"), "doc_id"), model)
    return got.join(labels.select("doc_id", wanted), "doc_id")


def test_quality_on_held_out_labels(spark):
    got = _held_out(spark, quality, quality.graded, "quality").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in got]) > 0.98
    good, poor = ([r.expected_grade for r in got if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 1.5 and np.mean(poor) < 0.5


def test_toxicity_on_held_out_labels(spark):
    got = _held_out(spark, toxicity, toxicity.scored, "toxic").collect()
    assert np.mean([r.toxic == (r.toxic_label == 1) for r in (_renamed(r) for r in got)]) > 0.97
    assert all(0 <= r.p_toxic <= 1 and r.p_toxic <= r.expected_severity <= 2 for r in map(_renamed, got))


def _renamed(row):
    class Both:
        doc_id, expected_severity, p_toxic, severity, toxic, toxic_label = row
    return Both


@pytest.mark.parametrize("module, judge, pick", [(quality, quality.graded, quality.selected), (toxicity, toxicity.scored, None)])
def test_odd_rows_and_labels(docs, spark, module, judge, pick):
    schema = "doc_id long, quality int, toxic int, text string"
    some = [(4, 1, 0, "x"), (7, 0, 1, "x"), (7, 1, 0, "x"), (9, None, None, "x"), (None, 1, 1, "x"), (10, 1, None, "x"), (99, 0, 0, "x")]
    for rows in (some, []):
        model = module.model(docs(ODD), spark.createDataFrame(rows, schema))
        got = judge(docs(ODD), model).collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD)
        if pick:
            kept = Counter(r.doc_id for r in pick(docs(ODD), model).collect())
            assert kept == Counter(r.doc_id for r in got if r.kept)
        assert judge(docs(ODD).limit(0), model).collect() == []
    assert module.model(docs(ODD).limit(0), spark.createDataFrame(some, schema)).weights.any() == False  # noqa: E712


def test_sample_is_bounded_and_takes_the_lowest_rating(docs, spark):
    rated = spark.createDataFrame([(7, 2), (7, 1), (8, 0), (4, None)], "doc_id long, grade int")
    got = ordinal.sample(docs(ODD), rated).collect()
    assert sorted((r.grade, r.text) for r in got) == [(0, "the same words here"), (1, "the same words here")]
    assert ordinal.sample(docs(ODD), rated, rows=1).count() == 1
