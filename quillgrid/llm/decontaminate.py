"""Benchmark decontamination by one Aho-Corasick automaton over the test items.

Every run of 13 consecutive words of an item (or the whole item if it has fewer) is a
pattern of one automaton, which spells each word of the items in a few letters. A text is normalised
to its words and scanned once; a match is a run of words and is mapped to characters of the original text.

Nulls: a null text has no words and is never contaminated. An item without words gives no
window; one whose id is null is looked for, but not counted or listed among the items.
"""

import functools
import hashlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.tables import forget, stored
from quillgrid.llm.text import WORD_BYTES, kept_rows, per_batch, raw, words

WINDOW = 13
SHARE = 20                       # contaminated: at least 1 of so many words is hit
#: UTF-8 bytes of items in one automaton, which takes some hundred times that. It is in the memory of
#: every worker, so its size is checked; a larger set of items is cut into several, and each scans the texts in turn.
ITEM_BYTES = 256 << 10
#: Letters for each place of a word's code; a state looks for the next one among all it knows.
LETTERS = 64


@functools.lru_cache(maxsize=1)
def automaton(items: tuple[tuple[int | None, bytes], ...], size: int) -> tuple[dict[bytes, str], str, ahocorasick.Automaton]:
    """Codes of the items' words and of any other, all of one length, and windows as patterns; each has its words' count and its items."""
    numbers: dict[bytes, int] = {}
    for _, text in items:
        for x in words(text):
            numbers.setdefault(x, len(numbers))
    long = 1
    while LETTERS ** long < len(numbers):
        long += 1
    # each place has letters of its own, so that a pattern is only found where a word begins
    codes = {x: "".join(chr(1 + LETTERS * p + n // LETTERS ** p % LETTERS) for p in range(long)) for x, n in numbers.items()}
    del numbers
    found = ahocorasick.Automaton()
    owners: dict[frozenset, frozenset] = {}          # most windows have few items in common
    for item_id, text in items:
        w = [codes[x] for x in words(text)]
        for k in range(max(1, len(w) - size + 1) if w else 0):
            window = "".join(w[k:k + size])
            ids = found.get(window, (0, frozenset()))[1] | {item_id}
            found.add_word(window, (len(window) // long, owners.setdefault(ids, ids)))
    if len(found):
        found.make_automaton()
    return codes, "\0" * long, found


def scan(text: bytes, machine: tuple[dict[bytes, str], str, ahocorasick.Automaton]) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, disjoint runs of words that are hit as ``(first, end)``, and the items."""
    codes, other, found = machine
    w = words(text)
    if not w or not len(found):
        return len(w), [], set()
    runs, ids = [], set()
    for last, (n, owners) in found.iter("".join([codes.get(x, other) for x in w])):
        end = (last + 1) // len(other)
        runs.append((end - n, end))
        ids |= owners
    return len(w), joined(runs), ids


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs with overlapping or touching ones made one."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def in_original(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as ``(start, end)`` in characters of the text itself."""
    if not runs:
        return []
    plain = text.translate(WORD_BYTES)
    bounds, at = [], 0
    for word in plain.split():
        at = plain.index(word, at)
        bounds.append((at, at + len(word)))
        at += len(word)
    place = lambda b: len(text[:b].decode())
    return [(place(bounds[first][0]), place(bounds[end - 1][1])) for first, end in runs]


def shards(benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> list[tuple]:
    """The items, in sets whose size is bounded."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // item_bytes))
    out = []
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        out.append(tuple(sorted(((r[0], r[1].encode()) for r in part.collect()), key=lambda x: (x[0] is None, x))))
    return out


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, item_bytes: int = ITEM_BYTES,
         text: bool = False) -> DataFrame:
    """``doc_id, n_words, runs, items`` and, if asked for, ``text``; runs as a flat list of first and end words."""
    out = docs.select("doc_id", "text")
    parts = shards(benchmark, item_bytes)
    for k, items in enumerate(parts):
        carried = text or k + 1 < len(parts)

        def found(batch: pa.RecordBatch, items=items, before=k > 0) -> dict:
            machine = automaton(items, size)
            made = [scan(t, machine) for t in raw(batch)]
            runs = [r for _, r, _ in made]
            ids = [{i for i in x if i is not None} for _, _, x in made]
            if before:
                old = batch.column("runs").to_pylist()
                runs = [joined(r + list(zip(o[::2], o[1::2]))) for r, o in zip(runs, old)]
                ids = [i | {*o} for i, o in zip(ids, batch.column("items").to_pylist())]
            return {"doc_id": batch.column("doc_id").cast(pa.int64()), "text": batch.column("text"),
                    "n_words": [n for n, _, _ in made], "runs": [[x for run in r for x in run] for r in runs],
                    "items": [sorted(i) for i in ids]}
        before = out
        out = per_batch(out, found, "doc_id long," + "text string," * carried
                        + "n_words long,runs array<long>,items array<long>")
        if k + 1 < len(parts):      # one automaton at a time
            out = stored(out, "hits")
            if k:
                forget(before)
    return out


def digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = SHARE,
                  item_bytes: int = ITEM_BYTES) -> DataFrame:
    """One row per document: words, hit words, items found, and whether it is contaminated."""
    def judged(batch: pa.RecordBatch) -> dict:
        runs = [sum(r[1::2]) - sum(r[::2]) for r in batch.column("runs").to_pylist()]
        items = batch.column("items").to_pylist()
        n = batch.column("n_words").to_pylist()
        return {"doc_id": batch.column("doc_id"), "n_words": n, "n_hit": runs, "n_items": [len(i) for i in items],
                "items_sha256": [digest(i) for i in items],
                "contaminated": [h > 0 and share * h >= w for h, w in zip(runs, n)]}
    return per_batch(hits(docs, benchmark, size, item_bytes), judged, "doc_id long,n_words long,n_hit long,"
                     "n_items long,items_sha256 string,contaminated boolean")


def spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``doc_id, start, end``: hit passages as characters of the original texts."""
    def placed(batch: pa.RecordBatch) -> dict:
        rows = [(i, s, e) for i, t, r in zip(batch.column("doc_id").to_pylist(), raw(batch), batch.column("runs").to_pylist())
                for s, e in in_original(t, list(zip(r[::2], r[1::2])))]
        return {name: [r[k] for r in rows] for k, name in enumerate(("doc_id", "start", "end"))}
    return per_batch(hits(docs, benchmark, size, item_bytes, text=True), placed, "doc_id long,start long,end long")


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = SHARE, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The documents that are not contaminated, as they are: with one set of items decided within the row, without a join."""
    parts = shards(benchmark, item_bytes)
    if len(parts) > 1:
        rows = stored(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("nth")), "rows")
        bad = contamination(rows.select(F.col("nth").alias("doc_id"), "row.text"), benchmark, size, share, item_bytes).filter("contaminated")
        return rows.join(bad.select(F.col("doc_id").alias("nth")), "nth", "left_anti").select("row.*")

    def keeps(text: bytes, items=parts[0]) -> bool:
        n, runs, _ = scan(text, automaton(items, size))
        hit = sum(end - first for first, end in runs)
        return not (hit > 0 and share * hit >= n)
    return kept_rows(docs, keeps)
