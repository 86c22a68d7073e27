"""Exact token counts at every prefix of a text, by dynamic programming.

For a BPE vocabulary the last token of a prefix's encoding is the one token that ends
there and stands well after the last token of the prefix before it (two tokens stand well
together if encoding their joint text gives just these two). So one sweep over the text
gives the exact count of every prefix, and questions about truncation or budgets are
answered from the stored counts without encoding anything again.

Counts are stored as differences, one signed byte per character. As no token of the
vocabulary reaches over the start of a run of blanks, a text is swept word by word, and
words that start alike share the states of their common prefix.

Nulls: a null text is empty and has 0 tokens.
"""

import functools
import re
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from quillgrid.llm.text import per_batch, raw

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
BLANK = "▁"                 # how the vocabulary writes a blank
CHUNK = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: Entries of a worker's caches before they are emptied, and characters of the longest word
#: that enters them. Both change the time only.
CACHED, LONGEST = 300_000, 48

#: Of a prefix of a word: its last token, its count, whether its first token is a bare blank, and its differences.
State = tuple[str, int, bool, bytes]
START: State = ("", 0, False, b"")
SIGNED = [k.to_bytes(1, "little", signed=True) for k in [*range(128), *range(-128, 0)]]     # by k, also below 0


class Prefixes:
    """Counts for one sentencepiece BPE model with byte fallback and no normalisation."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        self.rank = {p: -model.get_score(k) for k, p in enumerate(pieces)
                     if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))}
        if any(BLANK in p.lstrip(BLANK) or (p.startswith(2 * BLANK) and p.strip(BLANK)) for p in self.rank):
            raise ValueError("a piece holds a blank after its start")
        self.width = max(map(len, self.rank))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.states: dict[str, State] = {"": START}
        self.chunks: dict[str, bytes] = {}
        self.runs = [0]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: adjacent ones merge, lowest rank first, leftmost first."""
        out, rank = list(text), self.rank
        while True:
            low, at = None, 0
            for k in range(len(out) - 1):
                here = rank.get(out[k] + out[k + 1])
                if here is not None and (low is None or here < low):
                    low, at = here, k
            if low is None:
                return out
            out[at:at + 2] = [out[at] + out[at + 1]]

    def stands(self, before: str, last: str) -> bool:
        """Whether ``last`` can follow ``before``, which is empty at the start of a word."""
        known = self.pairs.get((before, last))
        if known is None:
            known = self.merged(before + last) == ([before, last] if before else [last])
            self.pairs[before, last] = known
        return known

    def step(self, word: str, end: int, before: Callable[[int], State]) -> State:
        """The state of ``word[:end]`` from those of shorter prefixes."""
        rank, pairs = self.rank, self.pairs
        for size in range(1, min(end, self.width) + 1):
            token = word[end - size:end]
            if token in rank:
                cost = 1
            elif size == 1:
                cost = len(token.encode())
            else:
                continue
            last, count, bare = before(end - size)[:3]
            fits = pairs.get((last, token))
            if fits if fits is not None else self.stands(last, token):
                return token, count + cost, bare if count else token == BLANK, b""
        raise AssertionError("a prefix has no last token")

    def sweep(self, word: str) -> bytes:
        """What each character of a word adds to the count, sharing the states of words that start alike."""
        states = self.states
        known = states.get(word)
        if known is not None:
            return known[3]
        end = len(word) - 1
        while (known := states.get(word[:end])) is None:
            end -= 1
        for end in range(end + 1, len(word) + 1):
            made = self.step(word, end, lambda k: states[word[:k]])
            known = states[word[:end]] = (*made[:3], known[3] + SIGNED[made[1] - known[1]])
        return known[3]

    def long_sweep(self, word: str) -> list[State]:
        states = [START]
        for end in range(1, len(word) + 1):
            states.append(self.step(word, end, states.__getitem__))
        return states

    def run(self, blanks: int) -> int:
        """Tokens of a run of blanks."""
        while len(self.runs) <= blanks:
            self.runs.append(len(self.merged(BLANK * len(self.runs))))
        return self.runs[blanks]

    def deltas(self, chunk: str) -> bytes:
        """What each character of blanks and a word adds to the count, as signed bytes."""
        if chunk[1:2] != BLANK and len(chunk) <= LONGEST:
            return self.sweep(chunk)
        # several blanks: the last goes to the word unless the word's first token is a bare blank
        rest = chunk.lstrip(BLANK)
        blanks = len(chunk) - len(rest)
        counts = [0, *(self.run(k) for k in range(1, blanks + (not rest)))]
        if rest:
            joins, alone = self.run(max(0, blanks - 1)), self.run(blanks) - 1
            for last, n, bare, _ in self.long_sweep(BLANK * (blanks > 0) + rest)[1:]:
                counts.append(n + (alone if bare else joins))
        return np.diff(counts).astype(np.int8).tobytes()

    def count(self, text: str) -> bytes:
        """Differences of the counts at the prefixes of a whole text; sum them up to get the counts.

        The first character also pays for the blank that the model puts before a text.
        """
        if not text:
            return b""
        if len(self.chunks) > CACHED:
            self.chunks.clear()
        if len(self.states) > 4 * CACHED:
            self.states = {"": START}
        if len(self.pairs) > 4 * CACHED:
            self.pairs.clear()
        known, out = self.chunks, []
        for chunk in CHUNK.findall(BLANK + text.replace(" ", BLANK)):
            made = known.get(chunk)
            if made is None:
                made = self.deltas(chunk)
                if len(chunk) <= LONGEST:
                    known[chunk] = made
            out.append(made)
        all_of_them = b"".join(out)
        first = np.frombuffer(all_of_them[:2], np.int8).sum(dtype=np.int8).tobytes()
        return first + all_of_them[2:]


@functools.cache
def prefixes(path: str) -> Prefixes:
    return Prefixes(path)


def at(deltas: bytes, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` characters."""
    return int(np.frombuffer(deltas, np.int8)[:n_chars].sum(dtype=np.int64))


def longest(deltas: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    fits = np.flatnonzero(np.frombuffer(deltas, np.int8).cumsum(dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, deltas``: the stored form, one byte per character of the text."""
    path = public_tokenizers.path(model)

    def counted(batch: pa.RecordBatch) -> dict:
        table = prefixes(path)
        return {"doc_id": batch.column("doc_id").cast(pa.int64()), "deltas": [table.count(t.decode()) for t in raw(batch)]}
    return per_batch(docs.select("doc_id", "text"), counted, "doc_id long,deltas binary")


def token_budget(docs: DataFrame, limit: int = LIMIT, model: str = MODEL) -> DataFrame:
    """Per document its bytes and tokens, whether these exceed ``limit``, and the characters that fit in it."""
    path = public_tokenizers.path(model)

    def counted(batch: pa.RecordBatch) -> dict:
        table, texts = prefixes(path), raw(batch)
        deltas = [table.count(t.decode()) for t in texts]
        n = [at(d, len(d)) for d in deltas]
        return {"doc_id": batch.column("doc_id").cast(pa.int64()), "n_bytes": [len(t) for t in texts], "n_tokens": n,
                "over_limit": [k > limit for k in n],
                "fit_chars": [len(d) if k <= limit else longest(d, limit) for k, d in zip(n, deltas)]}
    return per_batch(docs.select("doc_id", "text"), counted,
                     "doc_id long,n_bytes long,n_tokens long,over_limit boolean,fit_chars long")
