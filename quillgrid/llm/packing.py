"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous sweeps.

Documents are tokenised where they lie; only documents longer than a sequence are cut. The
pieces are range-sorted by length, longest first, so all pieces of one length form one run
of the global order and have ranks in it. Pieces of one length are alike, and so are gaps
of one size: a sweep matches all pieces of a length at once with the successor, the
smallest size of gap that holds them. Where more pieces want a size than there are gaps,
ranks decide: the first ones get them, the next go on to the successor after it, and what
finds none opens sequences. Gaps are updated, and the sweep repeats with the next length.
This gives as many sequences as placing the pieces one by one by best-fit decreasing.

Sweeps need only the numbers of pieces per length, of which there are at most as many as a
sequence has tokens, whatever the input. What they decide is a short list of ranges of
ranks; every task places its own pieces by it. Nothing is sorted or gathered in one task.

Nulls: a null text is empty and packs as its end token alone. A null doc_id stays null.
Rows that repeat are packed as often as they occur.
"""

import functools
import os
import re
import struct
import zlib
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgrid.llm.tables import stored
from quillgrid.llm.text import per_batch, raw
from quillgrid.plans.lineage import cut

MODEL = "word_bpe_49k.json"
CAPACITY, END = 2048, 0
#: Entries of a worker's caches before they are emptied, and bytes of the longest entry; time only.
CACHED, LONGEST = 150_000, 48


def _byte_letters() -> dict[int, str]:
    """How the vocabulary writes bytes: printable ones as themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()
#: A word of ASCII and Latin-1 letters and the ASCII punctuation after it, but for apostrophes.
#: The vocabulary's rules cut between the two, and nothing but the case of the word changes.
PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
#: Texts of these letters and ASCII only: no mark of another script changes a letter before it.
LATIN = re.compile(rb"(?:[\x00-\x7f]++|(?:\xc3[\x80-\xbf])++)*+")
#: In such a text, lower-cased, a mark between a letter and a blank: the rules cut before and after it.
MARK = re.compile(rb"(?<=[a-z\x9f-\xb6\xb8-\xbf])[,.;:!?](?=[\x09-\x0d\x20])")


class Ids:
    """Token ids of whole texts.

    The vocabulary drops white space and no token or rule reaches over it, so a text's ids
    are those of its parts between blanks, which mostly are known from before. A plain word
    goes to the library's merges at once, any other part through all of its rules.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        # entries in use enter the new cache again before the old one goes
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, parts: list[bytes]) -> list[bytes]:
        made = self.tokenizer.encode_batch([p.decode() for p in parts], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in made]

    def word(self, letters: bytes) -> bytes:
        text = letters.decode().lower()
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(BYTE_LETTERS)
        found = [t.id for t in self.merges.tokenize(text)]
        return struct.pack(f"<{len(found)}I", *found)

    def part(self, part: bytes) -> bytes:
        """Ids of a part between blanks."""
        made = self.known.get(part) or self.older.get(part)
        if made is None:
            plain = PLAIN.fullmatch(part) if b"<|" not in part else None      # special tokens start like this
            if plain is None or len(part) > LONGEST:
                made = self.encode([part])[0]
            elif plain[2]:
                made = self.part(plain[1]) + self.part(plain[2])
            else:
                made = self.word(part)
        if len(part) <= LONGEST:
            self.known[part] = made
        return made

    def of(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out = []
        for text in texts:
            if len(self.known) > CACHED:
                self.known, self.older = {}, self.known
            # upper case matters to special tokens, and to letters that a mark of another script follows
            if b"<|" not in text:
                if text.isascii():
                    text = MARK.sub(rb" \g<0>", text.lower())
                elif LATIN.fullmatch(text):
                    text = MARK.sub(rb" \g<0>", text.decode().lower().encode())
            parts = text.split()
            made = list(map(self.known.get, parts))
            if None in made:
                made = [self.part(p) if m is None else m for p, m in zip(parts, made)]
            out.append(b"".join(made))
        return out


@functools.cache
def ids(path: str) -> Ids:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark has a worker for each core
    return Ids(path)


def pieces(docs: DataFrame, capacity: int = CAPACITY, model: str = MODEL) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the documents' ids with the end token, cut if too long."""
    path = public_tokenizers.path(model)

    def divided(batch: pa.RecordBatch) -> dict:
        rows, end = [], np.array([END], "<u4").tobytes()
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw(batch)):
            made = ids(path).of([text])[0] + end
            for nth, at in enumerate(range(0, len(made), 4 * capacity)):
                part = made[at:at + 4 * capacity]
                rows.append((doc_id, nth, at // 4, len(part) // 4, zlib.crc32(part)))
        return {name: [r[k] for r in rows] for k, name in enumerate(("doc_id", "piece", "start", "length", "ids_crc32"))}
    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), divided,
                     "doc_id long,piece int,start long,length long,ids_crc32 long")


def sweeps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where pieces go, as ranges of ranks ``(first, sequence, offset, each, length)``.

    Ranks count pieces from the longest. From rank ``first`` on, each sequence from
    ``sequence`` on takes ``each`` pieces of ``length``, the first at ``offset``.
    """
    gaps: list[tuple[int, int, int]] = []      # size, first sequence, number of sequences; sorted
    out, rank, opened = [], 0, 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(gaps, (length, -1, 0))
            if at < len(gaps):
                size, sequence, n = gaps.pop(at)
                each = min(size // length, left)
                full = min(n, left // each)
                if full < n:
                    insort(gaps, (size, sequence + full, n - full))
            else:
                size, sequence, each = capacity, opened, min(capacity // length, left)
                full = left // each
                opened += full
            out.append((rank, sequence, capacity - size, each, length))
            rank, left = rank + full * each, left - full * each
            if size > each * length:
                insort(gaps, (size - each * length, sequence, full))
    return out


def placed(ranked: DataFrame, starts: list[int], ranges: list[tuple]) -> DataFrame:
    """Give each piece its place; row k of part p has rank ``starts[p] + k``."""
    first, sequence, offset, each, length = np.array(ranges or [(0, 0, 0, 1, 0)], np.int64).T

    def place(them):
        rank = starts[TaskContext.get().partitionId()]
        for batch in them:
            mine = np.arange(rank, rank + batch.num_rows)
            rank += batch.num_rows
            k = np.searchsorted(first, mine, "right") - 1
            nth = mine - first[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sequence[k] + nth // each[k]), pa.array(offset[k] + nth % each[k] * length[k])],
                names=[*batch.schema.names, "sequence_id", "offset"])
    return ranked.mapInArrow(place, "doc_id long,piece int,start long,length long,ids_crc32 long,"
                                    "sequence_id long,offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, model: str = MODEL) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # checkpointed, as the order and the parts must stay what they are from here on
    ranked = cut(
        stored(pieces(docs, capacity, model), "pieces")     # sorting by range reads its input twice
        .repartitionByRange(parts, F.desc("length"), "doc_id", "piece", "ids_crc32")
        .sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32"))
    # rows are sorted by length over the parts: fewer than `capacity` and the parts together
    tally = (ranked.groupBy(F.spark_partition_id().alias("part"), "length").count()).collect()
    counts: dict[int, int] = {}
    starts = [0] * (ranked.rdd.getNumPartitions() + 1)
    for part, length, n in tally:
        counts[length] = counts.get(length, 0) + n
        starts[part + 1] += n
    return placed(ranked, np.cumsum(starts).tolist(), sweeps(counts, capacity))
