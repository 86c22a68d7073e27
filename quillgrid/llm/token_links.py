"""Which tokens of one tokenizer overlap which of another, by products of sparse incidence matrices.

Token-byte incidence has a row for each token and a column for each byte of the text. The product of
one tokenizer's matrix with the other's transposed one, row by row (Gustavson), names for each token
the tokens of the other side that share bytes with it, and how many bytes. Where tokens of both sides end
the text falls into groups; products of token-group incidences link all tokens that share a group.

Both tokenizers cut before a single blank that a character other than white space follows, so everything
about a text is put together from its parts between such cuts. A worker aligns each part once, all new
parts of a batch in one product of block-diagonal matrices, and keeps the tables of frequent parts.

Corpus counts of linked id pairs are sums over documents; a document's own pairs are written down once and
meet the counts again in a join with pieces of the counts' table, each of at most ``BROADCAST_PAIRS`` rows.

Nulls: a null or empty text has no tokens, nor has one whose tokens don't spell it out (one with a literal
U+2581): zeros and an empty digest. A null doc_id stays null; rows that repeat are rows of their own and
count as often as they occur. Texts are never cut. Other columns are left out, whatever their names.
"""

import functools
import hashlib
import os
import re
from itertools import accumulate, chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from quillgrid.llm.packing import BYTE_LETTERS
from quillgrid.llm.tables import forget, stored
from quillgrid.llm.text import per_batch, raw

A_MODEL, B_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLANK = "▁"                                     # how B writes a blank
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
B_BITS = 15                                     # of an id of B; a pair is a_id << B_BITS | b_id
TIMES_BITS = 32                                 # a document's pairs are pair << TIMES_BITS | times
#: Rows of the counts' table that are broadcast at once, some 50 bytes each; more of them are joined in turn.
BROADCAST_PAIRS = 2_000_000
#: Parts a worker keeps, and bytes of the longest one; both change the time only.
CACHED, LONGEST = 250_000, 64


class Csr(NamedTuple):
    """A sparse matrix of ones: row i has its entries in ``columns[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    def transposed(self) -> "Csr":
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        order = np.argsort(self.columns, kind="stable")
        return Csr(_starts(np.bincount(self.columns, minlength=self.width)), rows[order], len(self.starts) - 1)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


def incidence(ends: np.ndarray) -> Csr:
    """Tokens by bytes, from the byte after each token."""
    n_bytes = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate([np.zeros(1, np.int64), ends]), np.arange(n_bytes), n_bytes)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``sizes`` of them, one after another."""
    at = _starts(sizes)
    return np.arange(at[-1]) + np.repeat(starts - at[:-1], sizes)


def product(a: Csr, b: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of a times b: each row of a adds up the rows of b that it names."""
    named = np.diff(b.starts)[a.columns]
    rows = np.repeat(np.repeat(np.arange(len(a.starts) - 1), np.diff(a.starts)), named)
    keys, values = np.unique(rows * b.width + b.columns[spans(b.starts[a.columns], named)], return_counts=True)
    return keys // max(b.width, 1), keys % max(b.width, 1), values


def row_sizes(a: Csr, b: Csr) -> np.ndarray:
    """Entries of each row of a times b without forming them, where rows of a name one row of b each."""
    return np.diff(b.starts)[a.columns]


class Alignment(NamedTuple):
    """Tokens of some parts, which follow one another, their groups and their links."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    a_link: np.ndarray        # tokens of A and B that overlap, in the order of A, and the bytes they share
    b_link: np.ndarray
    shared: np.ndarray
    mates: np.ndarray         # for each token of A the tokens of B in its group


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of_letter = {c: b for b, c in BYTE_LETTERS.items()}
        letters = [self.a.id_to_token(k) for k in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(of_letter[c] for c in x) if all(c in of_letter for c in x) else x.encode() for x in letters]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(x)) else x.replace(BLANK, " ").encode() for x in pieces]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in them]) for them in (self.a_bytes, self.b_bytes))
        if len(self.b_bytes) > 1 << B_BITS:
            raise ValueError(f"the second vocabulary has more than {1 << B_BITS} ids")
        self.names = [str(k) for k in range(max(len(self.a_bytes), len(self.b_bytes)))]

    def encoded(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides for each part, which a blank precedes; none where they don't spell it."""
        texts = [" " + p for p in parts]
        a_ids = [x.ids for x in self.a.encode_batch(texts, add_special_tokens=False)]
        b_ids = self.b.encode(parts, num_threads=1)
        a_bytes, b_bytes = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for k, text in enumerate(texts):
            whole = text.encode()
            if b"".join(map(a_bytes, a_ids[k])) != whole or b"".join(map(b_bytes, b_ids[k])) != whole:
                a_ids[k], b_ids[k] = [], []
        return a_ids, b_ids

    def aligned(self, a_ids: list[list[int]], b_ids: list[list[int]]) -> Alignment:
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a_ids, b_ids))
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        links = product(incidence(a_ends), incidence(b_ends).transposed())
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        of = lambda group: Csr(np.arange(len(group) + 1), group, len(common))
        return Alignment(a, b, a_group, b_group, *links, row_sizes(of(a_group), of(b_group).transposed()))


@functools.cache
def aligner(a_path: str, b_path: str) -> Aligner:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark has a worker for each core
    return Aligner(a_path, b_path)


def parts_of(text: str) -> list[str]:
    """The text between its cuts, each part without the blank before it."""
    if not text:
        return []
    parts = text.split(" ")
    if "" in parts or any(p[0].isspace() for p in parts):
        parts = CUT.split(" " + text)
        parts[0] = parts[0][1:]
    return parts


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")


class Parts:
    """Tables of the parts a worker has met: counts, linked pairs and written groups."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.known: dict[str, int] = {}
        self.counts = np.empty((0, len(COUNTS)), np.int64)
        self.groups: list[str] = []
        self.starts, self.pairs = np.zeros(1, np.int64), np.empty(0, np.int64)
        self.uses = np.empty(0, np.int64)

    def learn(self, parts: list[str]) -> None:
        a_ids, b_ids = self.aligner.encoded(parts)
        x = self.aligner.aligned(a_ids, b_ids)
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(parts)) for ids in (a_ids, b_ids))
        a_part, b_part = np.repeat(np.arange(len(parts)), n_a), np.repeat(np.arange(len(parts)), n_b)
        n_links = np.bincount(a_part[x.a_link], minlength=len(parts))
        # groups are written out part by part
        n = int(x.a_group[-1]) + 1 if len(x.a_group) else 0
        a_at, b_at = (np.searchsorted(g, np.arange(n + 1)).tolist() for g in (x.a_group, x.b_group))
        names = self.aligner.names.__getitem__
        a_names, b_names = list(map(names, x.a_ids.tolist())), list(map(names, x.b_ids.tolist()))
        written = [f"{','.join(a_names[a0:a1])}|{','.join(b_names[b0:b1])}"
                   for a0, a1, b0, b1 in zip(a_at, a_at[1:], b_at, b_at[1:])]
        n_groups = np.bincount(a_part[a_at[:-1]], minlength=len(parts)) if n else np.zeros(len(parts), np.int64)
        at = list(accumulate(n_groups.tolist(), initial=0))
        n_shared = np.bincount(a_part, x.mates, minlength=len(parts)).astype(np.int64)
        self.known |= {p: k for k, p in enumerate(parts, len(self.groups))}
        self.groups += [";".join(written[u:v]) for u, v in zip(at, at[1:])]
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, n_links, n_shared], axis=1)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n_links)])
        self.pairs = np.concatenate([self.pairs, x.a_ids[x.a_link] << B_BITS | x.b_ids[x.b_link]])
        self.uses = np.concatenate([self.uses, np.zeros(len(parts), np.int64)])

    def forget(self) -> None:
        """Keep short parts that were used more than once, half of the cache at most."""
        uses = self.uses.tolist()
        often = sorted((p for p, k in self.known.items() if uses[k] > 1 and len(p) <= LONGEST), key=lambda p: -uses[self.known[p]])
        often = often[:CACHED // 2]
        old = np.array([self.known[p] for p in often], np.int64)
        sizes = np.diff(self.starts)[old]
        self.pairs = self.pairs[spans(self.starts[old], sizes)]
        self.starts, self.counts = _starts(sizes), self.counts[old]
        self.groups = [self.groups[k] for k in old.tolist()]
        self.known = {p: k for k, p in enumerate(often)}
        self.uses = np.zeros(len(often), np.int64)

    def rows(self, texts: list[str]) -> list[tuple]:
        """Per text its counts, the digest of its groups, and its pairs with their times."""
        split = [parts_of(t) for t in texts]
        known = self.known
        new = list(dict.fromkeys(p for parts in split for p in parts if p not in known))
        if new:
            self.learn(new)
        out = []
        for parts in split:
            at = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
            counts = self.counts[at]
            if not len(parts) or not counts[:, 0].all():      # a part that its tokens don't spell
                out.append((*[0] * len(COUNTS), "", []))
                continue
            different, uses = np.unique(at, return_counts=True)
            self.uses[different] += uses
            sizes = np.diff(self.starts)[different]
            pairs, which = np.unique(self.pairs[spans(self.starts[different], sizes)], return_inverse=True)
            times = np.bincount(which, np.repeat(uses, sizes)).astype(np.int64)
            digest = hashlib.sha256(";".join(map(self.groups.__getitem__, at.tolist())).encode()).hexdigest()
            out.append((*counts.sum(axis=0).tolist(), digest, pairs << TIMES_BITS | times))
        if len(known) > CACHED:
            self.forget()
        return out


@functools.cache
def parts(a_path: str, b_path: str) -> Parts:
    return Parts(aligner(a_path, b_path))


def alignments(docs: DataFrame, a_model: str = A_MODEL, b_model: str = B_MODEL) -> DataFrame:
    """Per document the ids of both sides, the group of each token, and the links with the bytes they share."""
    a_path, b_path = public_tokenizers.path(a_model), public_tokenizers.path(b_model)
    names = ("a_ids", "b_ids", "a_group", "b_group", "a_link", "b_link", "shared")

    def made(batch: pa.RecordBatch) -> dict:
        table, rows = aligner(a_path, b_path), []
        for text in raw(batch):
            a_ids, b_ids = table.encoded(parts_of(text.decode()))
            whole = all(a_ids)
            rows.append(table.aligned(a_ids, b_ids) if whole else table.aligned([], []))
        return {"doc_id": batch.column("doc_id").cast(pa.int64())} | {n: [getattr(r, n) for r in rows] for n in names}
    return per_batch(docs.select("doc_id", "text"), made, "doc_id long," + ",".join(f"{n} array<int>" for n in names))


def _aligned(docs: DataFrame, a_model: str, b_model: str) -> DataFrame:
    a_path, b_path = public_tokenizers.path(a_model), public_tokenizers.path(b_model)
    names = (*COUNTS, "groups_sha256", "pairs")

    def made(batch: pa.RecordBatch) -> dict:
        rows = parts(a_path, b_path).rows([t.decode() for t in raw(batch)])
        return {"doc_id": batch.column("doc_id").cast(pa.int64())} | {n: [r[k] for r in rows] for k, n in enumerate(names)}
    schema = ["doc_id long", *(f"{c} long" for c in COUNTS), "groups_sha256 string", "pairs array<long>"]
    return per_batch(docs.select("doc_id", "text"), made, ",".join(schema))


def link_counts(aligned: DataFrame) -> DataFrame:
    """``pair, count, best``: how many links hold two ids linked, and whether that is the most for the id of B."""
    pair, times = F.shiftright("code", TIMES_BITS).alias("pair"), F.col("code").bitwiseAND((1 << TIMES_BITS) - 1).alias("times")
    sums = aligned.select(F.explode("pairs").alias("code")).select(pair, times).groupBy("pair").agg(F.sum("times").alias("count"))
    # a window per id of B: one row at most for each id of A
    of_b = W.partitionBy(F.col("pair").bitwiseAND((1 << B_BITS) - 1))
    return sums.select("pair", "count", (F.col("count") == F.max("count").over(of_b)).alias("best"))


def link_report(docs: DataFrame, a_model: str = A_MODEL, b_model: str = B_MODEL) -> DataFrame:
    """Per document its tokens, groups and links, and how its links fare in the whole corpus."""
    aligned = stored(_aligned(docs, a_model, b_model).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stored(link_counts(aligned), "pairs")
    turns = max(1, -(-counts.count() // BROADCAST_PAIRS))
    codes = aligned.select("row", F.explode("pairs").alias("code")).select(
        "row", F.shiftright("code", TIMES_BITS).alias("pair"), F.col("code").bitwiseAND((1 << TIMES_BITS) - 1).alias("times"))
    sums, made = None, []
    for turn in range(turns):
        mine = (F.pmod(F.xxhash64("pair"), F.lit(turns)) == turn) if turns > 1 else F.lit(True)
        found = (codes.filter(mine).join(F.broadcast(counts.filter(mine)), "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("count")).alias("count_sum")))
        if turns > 1:       # one broadcast at a time
            found = stored(found, "sums")
            made.append(found)
        sums = found if sums is None else sums.unionByName(found)
    if turns > 1:
        sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = stored(aligned.drop("pairs").join(sums, "row", "left").select(
        "doc_id", *COUNTS, zero("n_best"), zero("count_sum"), "groups_sha256"), "links")
    forget(aligned, counts, *made)
    return out
