"""Cross-tokenizer alignment, against walks over whole encodings byte by byte."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from llm_cases import ODD, docs, tables  # noqa: F401
from quillgrid.llm import token_links


@pytest.fixture(scope="module")
def whole():
    """The plain form: both encodings of a whole text as ``(id, start, end)`` lists, None where they don't spell it."""
    a = Tokenizer.from_file(public_tokenizers.path(token_links.A_MODEL))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_links.B_MODEL))
    letters = {c: k for k, c in token_links.BYTE_LETTERS.items()}

    def placed(ids, spelled, want):
        out, at = [], 0
        for i, s in zip(ids, spelled):
            out.append((i, at, at + len(s)))
            at += len(s)
        return out if b"".join(spelled) == want else None

    def encode(text):
        if not text:
            return None
        want = (" " + text).encode()
        ids = a.encode(" " + text, add_special_tokens=False).ids
        x = placed(ids, [bytes(letters[c] for c in a.id_to_token(i)) for i in ids], want)
        ids = b.encode(text)
        spell = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
        y = placed(ids, [spell(b.id_to_piece(i)) for i in ids], want)
        return None if x is None or y is None else (x, y)
    return encode


def plain(rows, encode):
    """Expected rows, links token by token."""
    made, counts = [], Counter()
    for i, text in rows:
        both = encode(text)
        if both is None:
            made.append((i, None))
            continue
        a, b = both
        owner = {p: k for k, (_, s, e) in enumerate(b) for p in range(s, e)}
        links = sorted({(k, owner[p]) for k, (_, s, e) in enumerate(a) for p in range(s, e)})
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = defaultdict(lambda: ([], []))
        for side, tokens in enumerate((a, b)):
            for token, _, e in tokens:
                groups[ends[bisect_left(ends, e)]][side].append(token)
        counts.update((a[k][0], b[m][0]) for k, m in links)
        made.append((i, (a, b, links, [groups[e] for e in ends])))
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for i, it in made:
        if it is None:
            out.append((i, 0, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups = it
        named = [(a[k][0], b[m][0]) for k, m in links]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(len(x) * len(y) for x, y in groups),
                    sum(counts[p] == top[p[1]] for p in named), sum(counts[p] for p in named), hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "groups_sha256")


def rows_of(df):
    return Counter(tuple(r[n] for n in NAMES) for r in df.collect())


def random_texts(n):
    draw = random.Random(6)
    bits = ["the ", "and", " ", "  ", "\n", " \n", "\n ", "\t", "Wörter", "漢字", "🙂", ".", ", ", "'s", "12", "<s>", "<|endoftext|>", "a b",
            " ", "\x1c", "\x85", "\0", "ﬁ", "é", "straße", "http://x.y/z?a=b"]
    rows = [(k, "".join(draw.choice(bits) for _ in range(draw.randint(1, 25)))) for k in range(300)]
    return rows + [(300, "▁ literal"), (301, "x ▁"), (302, " leading"), (303, "trailing "), (304, "   "), (305, "x" * 5000)]


def test_random_texts(docs, whole):
    rows = random_texts(300)
    assert rows_of(token_links.link_report(docs(rows))) == plain(rows, whole)


@pytest.mark.parametrize("cached, broadcast", [(250_000, 2_000_000), (20, 300)])
def test_table_and_odd_rows(docs, tables, whole, monkeypatch, cached, broadcast):
    monkeypatch.setattr(token_links, "CACHED", cached)
    monkeypatch.setattr(token_links, "BROADCAST_PAIRS", broadcast)
    rows = tables.execute("select doc_id, text from documents where doc_id < 60").fetchall() + ODD
    assert rows_of(token_links.link_report(docs(rows))) == plain(rows, whole)


def test_query_over_the_whole_table(spark, tables, whole):
    from llm_cases import SMALL
    rows = tables.execute("select doc_id, text from documents").fetchall()
    got = token_links.link_report(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert rows_of(got) == plain(rows, whole)


def test_cache_forgets_rare_parts_only(whole, monkeypatch):
    monkeypatch.setattr(token_links, "CACHED", 40)
    table = token_links.Parts(token_links.aligner(*(public_tokenizers.path(m) for m in (token_links.A_MODEL, token_links.B_MODEL))))
    texts = [f"the same words and one of its own: own{k}" for k in range(200)]
    plainly = lambda rows: [(*r[:-1], list(r[-1])) for r in rows]
    first = plainly(table.rows(texts))
    assert "same" in table.known and len(table.known) <= 20
    assert plainly(table.rows(texts)) == first


def test_alignments(docs, whole):
    rows = [(1, "An alignment of tokens, both ways."), (2, None), (3, "▁")]
    got = {r.doc_id: r for r in token_links.alignments(docs(rows)).collect()}
    a, b = whole(rows[0][1])
    r = got[1]
    assert r.a_ids == [x for x, *_ in a] and r.b_ids == [x for x, *_ in b]
    shared = {(k, m): min(e, f) - max(s, t) for k, (_, s, e) in enumerate(a) for m, (_, t, f) in enumerate(b) if min(e, f) > max(s, t)}
    assert dict(zip(zip(r.a_link, r.b_link), r.shared)) == shared
    assert max(r.a_group) == max(r.b_group) and sorted(r.a_group) == r.a_group
    assert got[2].a_ids == got[3].a_ids == got[3].a_link == []


def test_product_of_matrices():
    draw = np.random.default_rng(2)
    x, y = (draw.random(s) < 0.3 for s in ((7, 9), (9, 5)))
    csr = lambda m: token_links.Csr(np.concatenate([[0], m.sum(axis=1).cumsum()]), np.nonzero(m)[1], m.shape[1])
    rows, columns, values = token_links.product(csr(x), csr(y))
    made = np.zeros((7, 5), int)
    made[rows, columns] = values
    assert (made == x.astype(int) @ y.astype(int)).all()
    back = csr(x).transposed()
    assert (np.repeat(np.arange(9), np.diff(back.starts)).tolist(), back.columns.tolist()) == tuple(map(list, map(np.ndarray.tolist, np.nonzero(x.T))))


def test_empty_table(docs):
    assert token_links.link_report(docs([])).isEmpty() and token_links.alignments(docs([])).isEmpty()
