"""Line-first cleaning, against plain counting and hand-made lines."""

import random
import re
from collections import Counter

import pytest

from llm_cases import ODD, docs  # noqa: F401
from quillgrid.llm import line_rules


def plain(text):
    """The base counts word by word."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    inside = {p for k in range(len(words) - 4) if windows[tuple(words[k:k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:k] for k, x in enumerate(lines)), len(inside))


def counts(row):
    return row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words


def test_odd_rows(docs):
    got = line_rules.line_report(docs(ODD)).collect()
    want = Counter((i, *plain(t)) for i, t in ODD)
    assert Counter((r.doc_id, *counts(r)) for r in got) == want
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 10)
    assert [r.n_repeat_words for r in got if r.doc_id == 10] == [20_000]


def test_random_texts(docs):
    draw = random.Random(4)
    rows = [(k, "".join(draw.choice(["a ", "b ", "c\t", "é ", "漢字 ", "\n", "\n\n", "# ", "a b c d e ", "\x0b", "\x1c", " "])
                        for _ in range(draw.randint(0, 60)))) for k in range(200)]
    got = {r.doc_id: counts(r) for r in line_rules.line_report(docs(rows)).collect()}
    assert got == {i: plain(t) for i, t in rows}


@pytest.mark.parametrize("line, rule", [
    ("A sentence that ends as it should.", None),
    ("She asked: “Is it so?”", None),
    ("An ellipsis is an end too…  ", None),
    ("これは文です。", None),
    ("A heading without an end", "punctuation"),
    ("Buy!! now!! it!! is!! cheap!!", "punctuation"),
    ("One shout in a line of ten words or more is let through, really!!", None),
    ("a## b$$ c%% d&& ends so.", "punctuation"),
    ("Home | News | Sport | About us.", "navigation"),
    ("one | two | and then a long sentence of many words follows that is no list at all.", None),
    ("Read more »", "navigation"),
    ("12 comments", "navigation"),
    ("All rights reserved.", "boilerplate"),
    ("We use cookies on this site.", "boilerplate"),
    ("The privacy policy of the ministry was discussed in parliament for many hours before it was passed.", None),
])
def test_rules(line, rule):
    assert line_rules.broken_rule(line, line.encode().split()) == rule


def test_failing_lines_go_before_documents_do(docs):
    prose = "Ten words stand in this sentence and they all stay."
    rows = [(1, f"Home | News | Sport\n{prose}\n\nRead more"), (2, "No end here at all\n" + prose), (3, f"{prose} {prose} {prose}"), (4, None)]
    kept = sorted(line_rules.cleaned(docs(rows)).collect())
    assert [(r.doc_id, r.text, r.lang, r.kept, r._row) for r in kept] == [(1, f"{prose}\n", "en", "x", "x"), (2, prose, "en", "x", "x")]
    heavy = [(5, prose + "\n" + " ".join(f"w{k}" for k in range(40)))]
    assert line_rules.cleaned(docs(heavy)).isEmpty()
    report = line_rules.line_report(docs(heavy)).first()
    assert (report.n_failed_lines, report.n_lost_words, report.base_failed, report.kept) == (1, 40, False, False)


def test_empty_table(docs):
    assert line_rules.line_report(docs([])).isEmpty() and line_rules.cleaned(docs([])).isEmpty()
