"""Phrases of words that stand together, against counting all phrases one by one."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from llm_cases import DOCUMENTS, ODD, docs  # noqa: F401
from quillgrid.llm import collocations


def plain(rows, least, top=2000, longest=4):
    """Expected rows for ``(lang, text)``."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            f.update(("und" if lang is None else lang, *w[k:k + s]) for s in range(1, longest + 1) for k in range(len(w) - s + 1))
    some = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = {(p[0], *p[k:k + s]) for p, a in some.items() for s in range(2, len(p) - 1) for k in range(1, len(p) - s + 1)
            if 100 * a >= 80 * f[(p[0], *p[k:k + s])]}
    found = []
    for p, a in some.items():
        if p not in gone:
            score, _, left, right = min((2_000_000 * a // (f[p[:k + 1]] + f[(p[0], *p[k + 1:])]), k, f[p[:k + 1]], f[(p[0], *p[k + 1:])])
                                        for k in range(1, len(p) - 1))
            found.append((p[0], " ".join(p[1:]), a, left, right, score))
    found.sort(key=lambda r: (r[0].encode(), -r[5], -r[2], r[1].encode()))
    out, rank = [], Counter()
    for lang, phrase, a, left, right, score in found:
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase, a, left, right, n[lang], score))
    return sorted(out)


NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def rows_of(df):
    return sorted(tuple(r[c] for c in NAMES) for r in df.collect())


@pytest.fixture(scope="module")
def by_language(spark):
    def build(rows):
        df = spark.createDataFrame([(k, t, lang, "s", 0) for k, (lang, t) in enumerate(rows)], DOCUMENTS)
        for name in ("word", "n", "x", "s", "id", "shard", "phrase", "rank", "key"):
            df = df.selectExpr("*", f"'x' as `{name}_`", f"'y' as {name if name != 's' else 't'}")
        return df.repartition(3)
    return build


def random_rows(n, seed):
    draw = random.Random(seed)
    bag = ["new york city hall", "to be or not to be", "a b", "A\tB", "the the the", "in spite of", "Größe é", "漢字 仮名", "rare%d", ", ", ".\n", "; ",
           "x", "y z", "\x0b", "\x1c", "of the"]
    return [(draw.choice(["en", "de", None, ""]), " ".join((w % draw.randint(0, 99) if "%" in w else w) for w in draw.choices(bag, k=draw.randint(0, 30))))
            for _ in range(n)]


@pytest.mark.parametrize("shard, held, positions, radix", [(1 << 18, 1 << 19, 1 << 21, 8), (3, 5, 40, 8), (7, 50, 500, 2)])
def test_random_texts(by_language, monkeypatch, shard, held, positions, radix):
    for name, value in (("SHARD", shard), ("HELD", held), ("POSITIONS", positions), ("RADIX_BITS", radix), ("RADIX", 1 << radix)):
        monkeypatch.setattr(collocations, name, value)
    rows = random_rows(60 if shard < 10 else 300, shard)
    least = 12 if shard < 10 else 30
    want = plain(rows, least)
    assert len(want) > 5
    assert rows_of(collocations.collocations(by_language(rows), least=least)) == want


def test_odd_rows_and_ties(docs):
    rows = ODD + [(20 + k, text) for k, text in enumerate(["p q. q p. r s", "s r"] * 40)]
    want = plain([("en", t) for _, t in rows], 30)
    assert rows_of(collocations.collocations(docs(rows))) == want
    assert ("en", "word word word word") in [(r[0], r[2]) for r in want]
    assert rows_of(collocations.collocations(docs(rows), top=2)) == plain([("en", t) for _, t in rows], 30, top=2)


def test_nothing_frequent(docs):
    assert collocations.collocations(docs([])).isEmpty()
    assert collocations.collocations(docs([(1, None), (2, "a b c")])).isEmpty()
    few = collocations.collocations(docs([(1, "a. " * 50)]))
    assert few.isEmpty() and few.columns == list(NAMES)


@pytest.mark.parametrize("n, highest, length, digits", [(1, 1, 2, 1), (500, 9, 3, 1), (5000, 300, 2, 2), (3000, 70_000, 4, 3)])
def test_double_array(n, highest, length, digits):
    draw = np.random.default_rng(n)
    phrases = np.unique(np.minimum(draw.zipf(1.3, (n, length)), highest), axis=0)
    ids = draw.permutation(len(phrases)) + 1
    trie = collocations.compiled(phrases, ids, digits)
    known = {tuple(p): i for p, i in zip(phrases.tolist(), ids.tolist())}
    x = np.minimum(draw.zipf(1.3, 20_000), highest).astype(np.int32)
    x[::7] = 0
    ever = np.ones(len(x), np.int32)
    ever[-length:] = 0
    got = collocations.advanced(trie, x, ever, length)
    assert got.tolist() == [known.get(tuple(x[k:k + length].tolist()), 0) if k < len(x) - length - 1 else 0 for k in range(len(x))]
    every = np.concatenate([*(np.append(p, 0) for p in phrases), np.zeros(length)]).astype(np.int32)
    ever = np.ones(len(every), np.int32)
    ever[-length:] = 0
    assert set(collocations.advanced(trie, every, ever, length)) - {0} == set(ids.tolist())


@pytest.mark.parametrize("keys, n", [([0], [1]), ([5, 6, 1 << 20, (1 << 62) - 1], [1, 300, 2, 1 << 40]), (list(range(0, 9000, 7)), [1] * 1286)])
def test_runs_keep_numbers_and_sums(keys, n):
    steps, counts = collocations._run(np.array(keys), np.array(n))
    assert np.cumsum(collocations._from_planes(steps)).tolist() == keys
    assert collocations._from_planes(counts).tolist() == n


@pytest.mark.parametrize("positions, words", [(1 << 19, 100), (50, 100), (50, 1 << 27)])
def test_proposals_are_summed_as_runs(spark, monkeypatch, positions, words):
    """Tasks send a row for each share, not for each pair of words, and all pairs come back with their sums."""
    monkeypatch.setattr(collocations, "POSITIONS", positions)
    draw = np.random.default_rng(2)
    made = [draw.integers(0, 40, 300, np.int32) for _ in range(20)]
    blocks = spark.createDataFrame([(x.tobytes(), x.tobytes()) for x in made], "x binary, s binary").repartition(4)
    for of, want in ((collocations._pairs, Counter(int(a) << 31 | int(b) for x in made for a, b in zip(x, x[1:]) if a and b)),
                     (collocations._states, Counter(int(a) for x in made for a in x if a))):
        for least in (1, 5):
            got = collocations.proposed(blocks, words, least, of).collect()
            assert len(got) == len({r.key for r in got})
            assert {r.key: r.n for r in got} == {k: n for k, n in want.items() if n >= least}
    sent = collocations.proposed(blocks, words, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in sent and "steps" in sent
