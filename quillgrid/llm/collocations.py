"""Phrases whose words stand together more often than apart, by language.

Phrases of two to four words are found level by level. A phrase can only be frequent if the phrases
without its last and without its first word are, so only such occurrences propose candidates of the next
length; proposals are summed in every task and shuffled as sorted runs, and rare ones go. The candidates of a
length are compiled into double-array tries, at most ``SHARD`` phrases each. A trie is broadcast, and numpy
moves the states of all text positions through it at once, one digit of a word's number after the other;
what ends in accepting states is counted in the same way, over batches, tasks and tries.

Texts are numbered once: a word too rare for any phrase and the border of a piece become one 0, so blocks
of numbers hold no more than what can match. Their states are written down for the next length.

Everything else is about phrases, not texts, and runs as joins on their numbers: a phrase knows its two
parts of one word less, and with them the frequencies of all its beginnings and ends.

Nulls: a null text is empty, a null language is ``und``. A document's id plays no part, and rows that repeat
count as often as they occur. Ties are settled by frequency and then by the bytes of the phrase, so ranks are
unique. Texts are never cut. Other columns are left out, whatever their names.
"""

from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.llm.tables import forget, stored
from quillgrid.llm.text import LOWER, UPPER, raw

LONGEST, LEAST, TOP = 4, 30, 2000   # words of a phrase, its frequency, phrases of a language
KEPT, OF = 80, 100                  # a phrase goes if a longer one has this share of its frequency
SCALE = 2_000_000
UNKNOWN = "und"
BORDER = b"\xff"                    # stands in no UTF-8 text
#: A-Z in lower case, and what ends a piece as one byte; split() then finds words of [^\x20\x09]+.
PIECES = bytes.maketrans(UPPER.encode() + b".,;:!?\n\v\f\r", LOWER.encode() + BORDER * 10)
ID_BITS = 31                        # of a word's or a phrase's number
SHARD = 1 << 18                     # words or phrases that are broadcast at once
HELD = 1 << 17                      # words a task counts before it hands them on
POSITIONS = 1 << 19                 # text positions whose proposals a task counts before it hands them on
DOCUMENTS = 32                      # of a block
SHARE = 1 << 22                     # words of the texts for which there is one share of the numbers to be counted
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
OUT = 1 << 16                       # rows of a batch
GROUP = 1 << 23                     # bytes of blocks that a reader or writer holds at once


def words(text: bytes) -> list[bytes]:
    """The words of a text, and ``BORDER`` between pieces."""
    return text.translate(PIECES).replace(BORDER, b" \xff ").split()


def _languages(batch: pa.RecordBatch) -> list[str]:
    return [UNKNOWN if x is None else x for x in batch.column("lang").to_pylist()]


def _parts(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in them:
        for at in range(0, batch.num_rows, DOCUMENTS):
            yield batch.slice(at, DOCUMENTS)


def _batches(**columns: pa.Array) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    yield from (whole.slice(at, OUT) for at in range(0, whole.num_rows, OUT))


# -- words ------------------------------------------------------------------------

def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, n``; the row of a language without a word has the number of all its words."""
    def counted(them):
        sums: dict[str, Counter] = defaultdict(Counter)

        def flush():
            for lang, counts in sums.items():
                counts.pop(BORDER, None)
                n = [*counts.values(), counts.total()]
                yield from _batches(lang=pa.array([lang] * len(n), pa.string()), n=pa.array(n, pa.int64()),
                                    word=pa.array([*(w.decode() for w in counts), None], pa.string()))
            sums.clear()
        for part in _parts(them):
            for lang, text in zip(_languages(part), raw(part)):
                sums[lang].update(words(text))
                if sum(map(len, sums.values())) > HELD:
                    yield from flush()
        yield from flush()
    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(counted, "lang string, n long, word string")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered(rows: DataFrame, *key: str) -> tuple[DataFrame, int, int]:
    """The rows with ``shard`` and with ``id`` from 1 on without gaps, the number of rows and that of shards."""
    total = rows.count()
    shards = max(1, -(-total // SHARD))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int"))
    # a shard has about SHARD rows
    rows = rows.withColumn("id", F.row_number().over(W.partitionBy("shard").orderBy(*key)).cast("long"))
    sizes = dict(rows.groupBy("shard").count().collect()) if shards > 1 else {}
    before = np.concatenate([[0], np.cumsum([sizes.get(k, 0) for k in range(shards)])]).tolist()
    return rows.withColumn("id", F.col("id") + F.get(F.lit(before), F.col("shard"))), total, shards


class _Numbers(dict):
    """Numbers of words; others have 0."""

    def __missing__(self, word: bytes) -> int:
        return 0


def _squeezed(x: np.ndarray) -> np.ndarray:
    """The numbers without a 0 after a 0, with one at the end."""
    x = np.append(x, np.int32(0))
    return x[(x != 0) | (np.concatenate([[1], x[:-1]]) != 0)]


def coded(docs: DataFrame, vocabulary: DataFrame, shards: int) -> DataFrame:
    """``x``: blocks of word numbers, which are the states of their positions at first."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col("lang").cast("string").alias("lang"), "text", F.lit(None).cast("binary").alias("x"))
    for shard in range(shards):
        names = sc.broadcast(vocabulary.filter(F.col("shard") == shard).select("lang", "word", "id").toArrow().combine_chunks())
        last = shard == shards - 1

        def numbers(them, names=names, last=last):
            known: dict[str, _Numbers] = defaultdict(_Numbers)
            for lang, word, number in zip(*(names.value.column(c).to_pylist() for c in ("lang", "word", "id"))):
                known[lang][word.encode()] = number
            for part in _parts(them):
                found = []
                for lang, text, x in zip(_languages(part), raw(part), part.column("x").to_pylist()):
                    its = words(text)
                    here = np.fromiter(map(known[lang].__getitem__, its), np.int32, len(its))
                    found.append(here if x is None else here + np.frombuffer(x, np.int32))
                if last:
                    block = _squeezed(np.concatenate([y for x in found for y in (x, np.zeros(1, np.int32))])).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["x"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [part.column("lang"), part.column("text"), pa.array([x.tobytes() for x in found], pa.binary())], names=["lang", "text", "x"])
        before = texts
        texts = stored(texts.mapInArrow(numbers, "x binary" if last else "lang string, text string, x binary"), "blocks", GROUP)
        if shard:
            forget(before)
        names.destroy()
    return texts


# -- tries ------------------------------------------------------------------------

class Trie(NamedTuple):
    """A double array: from state s a digit d leads to t = base[s] + d if check[t] = s; base of an accepting state is its number."""

    base: np.ndarray
    check: np.ndarray
    digits: int                     # of each word


FREE, NEVER, RADIX_BITS, RADIX = -1, -2, 8, 256
MANY, TRIES = 32, 24                # children that get room of their own at once, attempts for fewer


def digits_of(codes: np.ndarray, digits: int) -> np.ndarray:
    """The digits of numbers, the highest first, in a further dimension."""
    return (codes[..., None] >> (RADIX_BITS * np.arange(digits - 1, -1, -1))) & (RADIX - 1)


def compiled(phrases: np.ndarray, ids: np.ndarray, digits: int) -> Trie:
    """The trie of different phrases of one length, a row of word numbers each."""
    keys = digits_of(phrases, digits).reshape(len(phrases), -1)
    order = np.lexsort(keys.T[::-1])
    keys, ids = keys[order], ids[order]
    draw = np.random.default_rng(1)
    base, check = np.zeros(4 * RADIX, np.int32), np.full(4 * RADIX, FREE, np.int32)
    check[:RADIX] = NEVER           # the root is state 0, and nothing stands before RADIX or after the end
    used = RADIX
    slot = np.zeros(len(keys), np.int64)        # the state of each key at this depth
    for depth in range(keys.shape[1]):
        # a child is a run of keys that agree so far
        new = np.ones(len(keys), bool)
        new[1:] = (slot[1:] != slot[:-1]) | (keys[1:, depth] != keys[:-1, depth])
        first = np.flatnonzero(new)
        parent, digit = slot[first], keys[first, depth]
        owner, at, whose, size = np.unique(parent, return_index=True, return_inverse=True, return_counts=True)
        where = np.full(len(owner), FREE, np.int64)      # their bases
        need = 2 * (used + len(first)) + RADIX * (int((size >= MANY).sum()) + 2)
        if need > len(base):
            grown = need - len(base)
            base, check = np.append(base, np.zeros(grown, np.int32)), np.append(check, np.full(grown, FREE, np.int32))
        several = np.flatnonzero((size > 1) & (size < MANY))
        several = several[np.argsort(-size[several], kind="stable")]
        for _ in range(TRIES):
            if not len(several):
                break
            tried = draw.integers(RADIX, len(base) - 2 * RADIX, len(several))
            mine = np.repeat(np.arange(len(several)), size[several])
            wanted = tried[mine] + digit[_ranges(at[several], size[several])]
            claim = np.full(len(base), FREE, np.int64)
            claim[wanted[::-1]] = mine[::-1]             # the first to ask
            fits = np.ones(len(several), bool)
            fits[mine[(check[wanted] != FREE) | (claim[wanted] != mine)]] = False
            good = fits[mine]
            check[wanted[good]] = owner[several[mine[good]]]
            where[several[fits]] = tried[fits]
            several = several[~fits]
        large = np.concatenate([np.flatnonzero(size >= MANY), several])
        if len(large):                                   # room of their own at the end
            start = len(base) - RADIX
            grown = RADIX * len(large)
            base, check = np.append(base, np.zeros(grown, np.int32)), np.append(check, np.full(grown, FREE, np.int32))
            where[large] = start + RADIX * np.arange(len(large))
            mine = np.repeat(large, size[large])
            check[where[mine] + digit[_ranges(at[large], size[large])]] = owner[mine]
        alone = np.flatnonzero(size == 1)                # they fill the gaps
        holes = np.flatnonzero(check[:len(base) - RADIX] == FREE)[:len(alone)]
        where[alone] = holes - digit[at[alone]]
        check[holes] = owner[alone]
        base[owner] = where
        used += len(first)
        slot = (where[whose] + digit)[np.cumsum(new) - 1]
    base[slot] = ids
    return Trie(base, check, digits)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def advanced(trie: Trie, x: np.ndarray, before: np.ndarray, length: int) -> np.ndarray:
    """The accepting states of phrases of ``length`` words that start at each position, 0 where none does.

    ``before`` has the states of phrases one word shorter: a position starts out only if both of its are accepted.
    """
    at = np.flatnonzero((before[:-1] != 0) & (before[1:] != 0))
    state = np.zeros(len(at), np.int32)
    for k in range(length):
        codes = x[at + k]
        for d in range(trie.digits - 1, -1, -1):
            step = trie.base[state] + ((codes >> (RADIX_BITS * d)) & (RADIX - 1))
            stays = trie.check[step] == state
            at, codes, state = at[stays], codes[stays], step[stays]
    out = np.zeros(len(x), np.int32)
    out[at] = trie.base[state]
    return out


def tries(phrases: DataFrame, digits: int) -> DataFrame:
    """One trie for each shard of ``(id, shard, codes)``, compiled in a task of its own."""
    def made(key: tuple, table: pa.Table) -> pa.Table:
        codes = np.array(table.column("codes").combine_chunks().flatten()).reshape(table.num_rows, -1)
        trie = compiled(codes, np.array(table.column("id")), digits)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "base": pa.array([trie.base.tobytes()], pa.binary()),
                         "check": pa.array([trie.check.tobytes()], pa.binary())})
    return phrases.select("id", "shard", "codes").groupBy("shard").applyInArrow(made, "shard int, base binary, check binary")


def _blocks(them: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    for batch in them:
        for row in range(batch.num_rows):
            x, *more = (np.frombuffer(c[row].as_buffer(), np.int32) for c in batch.columns)
            yield x, more[0] if more else x, more[1:]


def _accepted(x: np.ndarray, states: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions inside accepted phrases, with one 0 between runs of them."""
    inside = np.zeros(len(x), bool)
    for k in range(min(length, len(x))):
        inside[k:] |= states[:len(x) - k] != 0
    stays = inside.copy()
    stays[1:] |= inside[:-1]        # the border after a run
    return np.where(inside, x, 0)[stays].astype(np.int32), states[stays]


def with_states(blocks: DataFrame, made: DataFrame, shards: int, digits: int, length: int) -> DataFrame:
    """``x, s``: what lies inside accepted phrases, and the states that all tries give, one broadcast trie at a time."""
    sc = blocks.sparkSession.sparkContext
    out = blocks
    for shard in range(shards):
        row = made.filter(F.col("shard") == shard).first()
        if row is None and shard < shards - 1:
            continue
        arrays = sc.broadcast((row["base"], row["check"]) if row else (b"\0" * 4 * 2 * RADIX, b"\xff" * 4 * 2 * RADIX))
        last = shard == shards - 1

        def step(them, arrays=arrays, last=last):
            base, check = (np.frombuffer(b, np.int32) for b in arrays.value)
            for x, before, more in _blocks(them):
                states = advanced(Trie(base, check, digits), x, before, length)
                states = states + more[0] if more else states        # a phrase is in one trie
                columns = _accepted(x, states, length) if last else [x, before, states]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["x", "s", "t"][:len(columns)])
        older, out = out, stored(out.mapInArrow(step, "x binary, s binary" if last else "x binary, s binary, t binary"), "blocks", GROUP)
        if older is not blocks:
            forget(older)
        arrays.destroy()
    return out


# -- candidates -------------------------------------------------------------------

def _pairs(s: np.ndarray) -> np.ndarray:
    """Two states that overlap in a longer phrase, as one number."""
    at = np.flatnonzero((s[:-1] != 0) & (s[1:] != 0))
    return s[at].astype(np.int64) << ID_BITS | s[at + 1]


def _states(s: np.ndarray) -> np.ndarray:
    return s[s != 0].astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Numbers from 0 on byte by byte, all their lowest bytes first, with as few bytes as the largest takes."""
    width = max(1, -(-int(x.max()).bit_length() // 8))
    return bytes([width]) + x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(planes: bytes | pa.Buffer) -> np.ndarray:
    planes = np.frombuffer(planes, np.uint8)
    out = np.zeros((len(planes[1:]) // int(planes[0]), 8), np.uint8)
    out[:, :planes[0]] = planes[1:].reshape(planes[0], -1).T
    return out.view("<i8").ravel()


def _run(keys: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending numbers as their steps, and how often each occurs."""
    return _planes(np.diff(keys, prepend=np.int64(0))), _planes(n)


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all runs, ascending, and their sums."""
    keys, n = (np.concatenate([r[k] for r in runs]) for k in (0, 1))
    order = keys.argsort(kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def proposed(blocks: DataFrame, n_words: int, least: int, of=_pairs) -> DataFrame:
    """``key, n`` for the numbers that ``of`` finds in the states of blocks at least ``least`` times.

    Each number has one share, drawn by its hash; there is one for each ``SHARE`` words, so a share has at most about
    as many numbers whatever the texts. A task counts what it meets in ``POSITIONS`` positions and sends
    a sorted run for each share, the runs of a share are merged in a task.
    """
    shares = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_words // SHARE))

    def counted(them):
        held, size = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            share = (keys.astype(np.uint64) * MULTIPLIER >> np.uint64(32)) % np.uint64(shares)
            order = share.argsort(kind="stable")         # ascending within a share
            keys, n, share = keys[order], n[order], share[order]
            ends = np.append(np.flatnonzero(np.diff(share)) + 1, len(share))
            rows = [(int(share[low]), *_run(keys[low:high], n[low:high])) for low, high in zip(np.append(0, ends), ends) if high > low]
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))],
                                             names=["share", "steps", "counts"])
        for _, s, _ in _blocks(them):
            held.append(of(s))
            size += len(s)
            if size > POSITIONS:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    def summed(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, runs, size = None, [], 0

        def whole():
            keys, n = _merged(runs)
            often = n >= least
            runs.clear()
            yield from _batches(key=pa.array(keys[often]), n=pa.array(n[often]))
        for batch in them:
            for its, steps, counts in zip(batch.column("share").to_pylist(), batch.column("steps"), batch.column("counts")):
                if its != share and runs:
                    yield from whole()
                    size = 0
                share = its
                runs.append((np.cumsum(_from_planes(steps.as_buffer())), _from_planes(counts.as_buffer())))
                size += len(runs[-1][0])
                if len(runs) > 1 and size > POSITIONS + 2 * len(runs[0][0]):     # a run of all so far, and what came since
                    runs[:] = [_merged(runs)]
                    size = len(runs[0][0])
        if runs:
            yield from whole()
    runs = blocks.mapInArrow(counted, "share int, steps binary, counts binary")
    return runs.repartition(shares, "share").sortWithinPartitions("share").mapInArrow(summed, "key long, n long")


def _longer(pairs: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases from the phrases without their last and without their first word."""
    head = shorter.select(F.col("id").alias("head"), "lang", "phrase", "codes", "heads", "n")
    tail = shorter.select(F.col("id").alias("tail"), "last", "tails", F.col("n").alias("tail_n"), F.element_at("codes", -1).alias("code"))
    return pairs.join(head, "head").join(tail, "tail").select(
        "id", "shard", "head", "tail", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last",
        F.concat("codes", F.array("code")).alias("codes"), F.concat("heads", F.array("n")).alias("heads"),
        F.concat("tails", F.array("tail_n")).alias("tails"))


def _scored(phrases: DataFrame, length: int) -> DataFrame:
    """The lowest-scoring cut of each phrase."""
    def scored(k: int):
        l, r = F.get("heads", F.lit(k - 1)), F.get("tails", F.lit(length - k - 1))
        exact = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * F.col("n").cast("decimal(19,0)"),
                                l.cast("decimal(19,0)") + r.cast("decimal(19,0)"))
        return F.struct(exact.cast("long").alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))
    cuts = [scored(k) for k in range(1, length)]
    best = cuts[0] if len(cuts) == 1 else F.least(*cuts)
    return phrases.withColumn("best", best).select("lang", "phrase", F.col("n").alias("a"), "best.l", "best.r", "best.score")


def phrase_levels(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of 1, 2, ... words with what they are made of, and ``lang, total``: all words of each language."""
    counts = stored(word_counts(docs).filter((F.col("n") >= least) | F.col("word").isNull()), "words")
    totals = counts.filter("word is null").select("lang", F.col("n").alias("total"))
    vocabulary, total, shards = numbered(counts.filter("word is not null"), "lang", "word")
    vocabulary = stored(vocabulary, "vocabulary")
    n_words = totals.agg(F.sum("total")).first()[0] or 0
    digits = max(1, -(-total.bit_length() // RADIX_BITS))
    blocks = coded(docs, vocabulary, shards)
    none = F.array().cast("array<long>")
    levels = [vocabulary.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n",
                                F.array(F.col("id").cast("int")).alias("codes"), none.alias("heads"), none.alias("tails"))]
    for length in range(2, longest + 1):
        sums = stored(proposed(blocks, n_words, least), "proposed")
        pairs, total, shards = numbered(sums.select("key"), "key")
        if not total:
            forget(sums)
            break
        pairs = pairs.select("id", "shard", F.shiftright("key", ID_BITS).alias("head"),
                             F.col("key").bitwiseAND((1 << ID_BITS) - 1).alias("tail"))
        phrases = stored(_longer(pairs, levels[-1]), "phrases")
        made = stored(tries(phrases, digits), "tries")
        older, blocks = blocks, with_states(blocks, made, shards, digits, length)
        accepted = proposed(blocks, n_words, 1, _states).select(F.col("key").alias("id"), "n")
        levels.append(stored(phrases.join(accepted, "id"), "level"))
        forget(sums, phrases, made, older)
    forget(blocks)
    return levels, totals


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first phrases of each language.

    ``a`` is the frequency of the phrase, ``l`` and ``r`` are those of the two sides of its lowest-scoring cut.
    """
    levels, totals = phrase_levels(docs, least, longest)
    out = None
    for length, phrases in enumerate(levels[1:], 2):
        if length < len(levels):    # of all longer phrases around one, those of one word more are the most frequent
            around = levels[length].select(F.col("head").alias("id"), "n").unionByName(levels[length].select(F.col("tail").alias("id"), "n"))
            around = around.groupBy("id").agg(F.max("n").alias("around"))
            phrases = phrases.join(around, "id", "left").filter(
                F.col("around").isNull() | (OF * F.col("around") < KEPT * F.col("n")))
        mine = _scored(phrases, length)
        out = mine if out is None else out.unionByName(mine)
    if out is None:
        out = _scored(levels[0], 2).limit(0)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                              F.col("total").alias("n"), "score")
