"""Search, extraction, licenses, surrogates and the pipeline."""

import re
from collections import Counter
from math import log

import pytest
from llm_cases import ODD, SMALL, docs, tables  # noqa: F401

import corpus_pipeline
from quillgrid.llm import bm25, html_text, licenses, surrogates


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _bm25(rows, queries, k):
    tf = [Counter(_words(t)) for _, t in rows]
    mean = sum(sum(c.values()) for c in tf) / len(rows)
    out = {}
    for q, of in queries.items():
        scored = []
        for (doc_id, _), c in zip(rows, tf):
            if any(t in c for t in of):
                size = bm25.K1 * (1 - bm25.B + bm25.B * sum(c.values()) / mean)
                s = sum(w * c[t] * (bm25.K1 + 1) / (c[t] + size) for t, w in of.items() if t in c)
                scored.append((-round(s, 9), doc_id is None, doc_id or 0, doc_id))
        out[q] = [(x[3], -x[0]) for x in sorted(scored, key=lambda x: x[:3])[:k]]
    return out


def _telling(rows, every, size):
    tf = [(i, Counter(_words(t))) for i, t in rows]
    df = Counter(t for _, c in tf for t in c)
    idf = {t: log(1 + (len(rows) - n + 0.5) / (n + 0.5)) for t, n in df.items() if n > 1}
    out = {}
    for i, c in tf:
        if i is not None and i % every == 0:
            best = sorted(((-(1 + log(c[t])) * idf[t], bm25.terms(t.encode())[0][0], t) for t in c if t in idf))[:size]
            if best:
                out[i] = {t: idf[t] for _, _, t in best}
    return out


@pytest.mark.parametrize("shard, block, queries", [(8192, 64, 20_000), (7, 2, 3)])
def test_search_is_exact(docs, spark, tables, monkeypatch, shard, block, queries):
    rows = tables.execute("select doc_id, text from documents").fetchall() + ODD
    monkeypatch.setattr(bm25, "SHARD_DOCS", shard)
    monkeypatch.setattr(bm25, "BLOCK", block)
    if shard == 8192:
        got = bm25.similar_documents(docs(rows), every=5)
    else:
        df, n, mean = bm25.statistics(docs(rows))
        got = bm25.top(docs(rows), bm25.as_queries(docs(rows).filter("doc_id % 5 = 0"), df, n), mean, k=10, block=queries)
    found: dict = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 9)))
    want = _bm25(rows, _telling(rows, 5, bm25.TERMS), 10)
    assert set(found) == set(want)
    for q in want:
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in want[q]], abs=1e-8)
        sure = [d for d, s in want[q] if s > want[q][-1][1] + 1e-8]
        assert {*sure} <= {d for d, _ in found[q]}


def test_wand_skips_and_keeps_ties():
    from random import Random
    draw = Random(7)
    for _ in range(200):
        n, lists = draw.randint(1, 300), []
        for _ in range(draw.randint(1, 7)):
            of = sorted(draw.sample(range(n), draw.randint(1, n)))
            lists.append(bm25.Postings(of, [draw.choice([0.3, 0.6, 1.1, draw.random()]) for _ in of]))
        weights = [draw.choice([0.5, 1.0, 7.1]) for _ in lists]
        scores: dict = {}
        for x, w in zip(lists, weights):
            for d, a in zip(x.docs, x.adds):
                scores[d] = scores.get(d, 0.0) + w * a
        want = sorted(((s, d) for d, s in scores.items()), key=lambda x: (-x[0], x[1]))[:10]
        assert bm25.search(lists, weights, 10) == want


def test_search_without_documents(docs):
    assert bm25.similar_documents(docs(ODD).limit(0)).collect() == []
    assert bm25.similar_documents(docs([(20, None), (40, "")])).collect() == []


PAGE = """<html><head><title>No</title><style>p{}</style></head><body><header class=top><a href=/>Home</a></header>
<div id="cookie-notice">We use cookies on this site to give you the best experience.</div>
<div class="wrap"><div class="content"><h1>The  title</h1><p>First &amp; long paragraph of the article with enough words to count,
 and <a href=x>one link</a> inside.<p>Second paragraph&nbsp;goes on<br>for a while, with more text than any menu has.</p>
<ul><li>point one<li>point two</ul></div><aside>Read this as well</aside></div>
<form><input name=q><button>Search</button></form><div class="comments"><p>I am a reader and I have a long opinion on all of this,
and I say it here at length so that it would weigh much.</p></div><footer>All rights &copy; us</footer><script>var a = "<p>no</p>";</script>"""


def test_article_of_a_page_without_article_element():
    assert html_text.main_text(PAGE) == ("The title\nFirst & long paragraph of the article with enough words to count, and one link inside.\n"
                                         "Second paragraph goes on for a while, with more text than any menu has.\npoint one\npoint two")


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<article><p>x &lt;b&gt; y</article><nav>menu</nav>", "x <b> y"),
    ("<div>unclosed <b>bold", "unclosed bold"), ("<!-- only --><script>x</script>", ""), ("</p></div>text<", "text<"),
    ("<article><header><h1>T</h1></header><p>body</p></article>", "T\nbody"), ("<article><p>a</p><section class=comments>c</section>", "a"),
    ("<div class=ad>buy<article><p>kept</article>", "kept"), ("<div id=comments><article class=comment>no</article></div><p>yes", "yes"),
    ("<article><header>" + "<div>" * 3000 + "<h1>T</h1>", "T"), ("<a href=\"x>y</a><p>z", "y\nz"),
    ("<p>" * 3000 + "deep", "deep"), ("<div>" * 3000 + "deep", "deep")])
def test_pages(page, text):
    assert html_text.main_text(page) == text


def test_pages_of_table(spark, tables):
    import html
    got = {r.page_id: r for r in html_text.extracted(spark.read.parquet(f"{SMALL}/pages.parquet")).collect()}
    for i, page in tables.execute("select page_id, html from pages").fetchall():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", inner)]
        assert got[i].text == "\n".join(filter(None, parts)) and got[i].n_chars == len(got[i].text)


def test_odd_pages(spark):
    rows = [(1, "u", None), (None, None, "<p>x"), (1, "u", None), (2, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    assert Counter(map(tuple, html_text.extracted(df).collect())) == Counter(
        [(1, "u", "", 0), (None, None, "x", 1), (1, "u", "", 0), (2, "u", "", 0)])
    assert html_text.extracted(df.limit(0)).collect() == []


LICENSED = [
    ("Released under the MIT License.", "mit", ""), ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc", "cc-by"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl", "gpl"), ("general public LICENSE", "gpl", "gpl"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0", ""), ("Licensed under the Apache License, Version 3.0.", "", ""),
    ("Copyright (c) 2020 Some One Ltd, all rights reserved", "reserved", "reserved"), ("all rights were reserved", "", ""),
    ("released under the terms of the mit license", "mit", ""), ("released under the old mit license", "", ""), ("cc. by", "cc-by", "cc-by"),
    ("licensed under a Creative Commons Attribution NonCommercial ShareAlike 4.0 license", "cc-by,cc-by-nc,cc-by-nc-sa", "")]


def test_licenses(docs):
    got = {r.doc_id: r for r in licenses.license_scan(docs(list(enumerate(x[0] for x in LICENSED)))).collect()}
    assert [(got[k].labels, got[k].base_labels) for k in range(len(LICENSED))] == [x[1:] for x in LICENSED]
    assert all((r.score > 0) == bool(r.labels) and 0 <= r.score <= 1 for r in got.values())


def test_phrases_of_table(spark, tables):
    got = {r.doc_id: r for r in licenses.license_scan(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    for i, text in tables.execute("select doc_id, text from documents").fetchall():
        w = _words(text)
        at = [k for p in licenses.PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))


def test_odd_rows_have_no_license(docs):
    got = licenses.license_scan(docs(ODD)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD) and not any(r.labels or r.score for r in got)
    assert licenses.license_scan(docs(ODD).limit(0)).collect() == []


def test_a_template_with_all_kinds_of_regions():
    machine = licenses.Automaton((("x", "start [very [much]] (one | two words) {1,2} end"),))
    accepts = lambda text: "x" in machine.accepted(text.encode().split(), 0)
    assert all(map(accepts, ["start one a end", "start very two words a b end", "start very much one a end of it"]))
    assert not any(map(accepts, ["start one end", "start much one a end", "start two a end", "start one a b c end", "one a end"]))
    with pytest.raises(ValueError):
        licenses.Automaton((("x", "open [region"),))


PRIVATE = [(1, "Mail und.34@mail7.example.com or UND.34@mail7.example.com, call +1 (017) 555-7713."),
           (2, "und.34@mail7.example.com again; card 4477442802515473 4532 0151 1283 0366, not 1234567812345678; ip 97.51.17.173"),
           (3, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and 017-555-7713 and +1 (017) 555-7713'),
           (4, "Frau Schmidt met Mr. John Brown and Mrs. Anna Brown; Frau Schmidt left. Herr Иванов too."),
           (5, "SSN 078-05-1120, IBAN DE89 3704 0044 0532 0130 00"), (6, "Nothing here: version 1.2.3, 12:30, 2024-01-02, a@b."), *ODD]


def test_surrogates(docs):
    new = {r.doc_id: (r.text, r.n_entities) for r in surrogates.replaced(docs(PRIVATE), count="n_entities").collect()
           if r.doc_id is not None and r.doc_id <= 6 and r.text and len(r.text) > 5}
    old = dict(PRIVATE[:6])
    for secret in ("und.34", "mail7", "555-7713", "4532 0151", "04dbebab91", "97.51.17.173", "Schmidt", "John", "Иванов", "078-05", "3704 0044"):
        assert not any(secret.lower() in t.lower() for t, _ in new.values())
    mails = re.findall(r"\S+@\S+?\.com", new[1][0] + " " + new[2][0])
    assert len({m.lower() for m in mails}) == 1 and len(mails) == 3 and re.fullmatch(r"[a-z]{3}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", mails[0])
    assert "1234567812345678" in new[2][0] and new[6] == (old[6], 0)
    cards = re.findall(r"4532 \d{4} \d{4} \d{4}", new[2][0])
    assert len(cards) == 1 and sum(sum(divmod(int(d) * (2 if k % 2 else 1), 10)) for k, d in enumerate(cards[0].replace(" ", "")[::-1])) % 10 == 0
    assert re.search(r'token = "[0-9a-f]{40}" and', new[3][0])
    phones = re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4})", new[1][0] + new[3][0])
    assert len(set(phones)) == 1 and len(phones) == 2
    m = re.fullmatch(r"Frau (\w+) met Mr\. (\w+) (\w+) and Mrs\. (\w+) (\w+); Frau (\w+) left\. Herr ([а-яА-Я]+) too\.", new[4][0])
    assert m and m[1] == m[6] and m[2] in surrogates.MALE_NAMES and m[4] in surrogates.FEMALE_NAMES


def test_texts_without_entities_stay(docs):
    got = surrogates.replaced(docs(ODD))
    assert got.columns == docs(ODD).columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, docs(ODD).collect()))
    assert surrogates.without_private_data(docs(PRIVATE).limit(0)).collect() == []


def test_no_two_entities_become_one(spark, monkeypatch):
    """Addresses drawn from 16 values only, so that first draws do collide."""
    from pyspark.sql import functions as F
    real = surrogates.surrogate
    few = lambda kind, entity: F.when(kind == "ip", F.concat(F.lit("ip"), (surrogates._draw(0) % 16).cast("string"))).otherwise(real(kind, entity))  # noqa: E731,E501
    monkeypatch.setattr(surrogates, "surrogate", few)
    them = spark.createDataFrame([("ip", f"ip{k}") for k in range(5)] + [("ip", f"10.0.0.{k}") for k in range(4)], "kind string, entity string")
    got = surrogates.mapping(them).collect()
    fakes = [r.fake for r in got]
    assert len(set(fakes)) == 9 and not {f"ip{k}" for k in range(5)} & set(fakes)
    with pytest.raises(ValueError):
        surrogates.mapping(spark.createDataFrame([("ip", f"10.0.0.{k}") for k in range(20)], "kind string, entity string"), attempts=3)


def test_stages_take_effect(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontaminate", "pii", "pack"]
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, rows = df.columns, [df.count()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        df = corpus_pipeline.stored(stage(spark, df, SMALL), name)
        assert df.columns == columns
        rows.append(df.count())
    assert rows == sorted(rows, reverse=True) and rows[0] > rows[1] > rows[2] >= rows[3] == rows[4] > 0
    packed = corpus_pipeline.run(spark, SMALL)
    assert packed.select("doc_id").distinct().count() == rows[-1]
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_pipeline_over_odd_documents(docs, spark, tmp_path):
    docs(PRIVATE).write.parquet(f"{tmp_path}/documents.parquet")
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {i for i, _ in PRIVATE} - {8}
