"""Line-first cleaning: rules judge each line, failing lines go, then documents that lost too much.

A line without a word is neutral and stays. A line with words fails by the first rule it breaks:

* ``navigation``: a list of entries between separators, or nothing but a menu phrase or a counter;
* ``boilerplate``: a short line with wording that pages repeat (consent, terms, scripts, placeholder text);
* ``punctuation``: it does not end like a sentence, or more than a tenth of its words carry runs of
  symbols or of exclamation and question marks.

A document is rejected if it has too few words or repeats itself (``base_failed``), or if the
failing lines hold more than ``LOST`` percent of its words. One pass in Arrow batches, no shuffle.

Nulls and empty texts have no words and fail. A null doc_id stays null, and each row is judged by
its own text alone, so rows that repeat are judged alike. Texts are never cut, whatever their length.
Other columns of the table are carried along by ``cleaned`` and may have any name.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from quillgrid.llm.text import LOWER, ROWS, UPPER, per_batch, raw

WINDOW = 5                        # words
LEAST_WORDS = 10
REPEATED = 20                     # percent of the words that may stand in repeated windows
LOST = 50                         # percent of the words that failing lines may hold
NOISE = 10                        # percent of a line's words that may carry runs of marks
SHORT = 12                        # words of a line that menu phrases and boilerplate wording condemn

# fixed values: what the rules look for; SQL engines understand the patterns alike
BLANKS = " \t\n\v\f\r"
ENDS, CLOSERS = ".!?…。！？:;", "\"'”’»)]"
MARKS = rb"[#*$%&|<>]{2}|[!?]{2}"
SEPARATORS = "|»›•·"
MENU = (r"[\x20\x09-\x0D]*(?:home|menu|next|previous|back to top|read more|continue reading|skip to content|"
        r"skip to main content|share|share this|tweet|print|log in|login|sign in|sign up|register|search|contact|"
        r"contact us|about|about us|faq|sitemap|site map|rss|[0-9]+ (?:comments?|likes?|shares?|views?|replies))"
        r"[.:!»›>\x20\x09-\x0D]*")
BOILERPLATE = (r"lorem ipsum|javascript|cookie|privacy policy|terms of use|terms of service|terms and conditions|"
               r"all rights reserved|copyright|©|click here|subscribe|newsletter|powered by|follow us")
SYMBOLS = b"#*$%&|<>"

#: What is deleted to count the characters of words: white space and the later bytes of a character.
NO_CHARACTER = BLANKS.encode() + bytes(range(0x80, 0xC0))
_MARKS, _MENU, _BOILERPLATE = re.compile(MARKS), re.compile(MENU), re.compile(BOILERPLATE)
_LOW = str.maketrans(UPPER, LOWER)


class _Numbers(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = made = len(self)
        return made


def in_repeated_windows(words: list[bytes], size: int = WINDOW) -> int:
    """Words that stand in windows of ``size`` words found twice or more."""
    if len(words) <= size:
        return 0
    numbers = _Numbers()
    one = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    windows = one
    for k in range(1, size):        # the windows of k + 1 words, numbered without gaps
        found, windows = np.unique(windows[:-1] * len(numbers) + one[k:], return_inverse=True)
        if len(found) == len(windows):       # no two alike, nor any longer ones
            return 0
    again = np.flatnonzero(np.bincount(windows)[windows] > 1)
    steps = np.zeros(len(words) + 1, np.int64)
    steps[again] += 1
    steps[again + size] -= 1
    return int(np.count_nonzero(np.cumsum(steps[:-1])))


def broken_rule(line: str, words: list[bytes], marks: bool = True, separators: bool = True) -> str | None:
    """The first rule that a line breaks; the flags say whether its text holds such characters at all."""
    n = len(words)
    if separators and (found := sum(map(line.count, SEPARATORS))) > 1 and 3 * found >= n:
        return "navigation"
    if n <= SHORT:
        low = line.translate(_LOW)
        if _MENU.fullmatch(low):
            return "navigation"
        if _BOILERPLATE.search(low):
            return "boilerplate"
    if line.rstrip(BLANKS).rstrip(CLOSERS)[-1:] not in tuple(ENDS):
        return "punctuation"
    return "punctuation" if marks and 100 * sum(_MARKS.search(w) is not None for w in words) > NOISE * n else None


class Judged:
    """A text after the rules: its counts, the lines that stay, and the verdict."""

    def __init__(self, raw_text: bytes):
        words = raw_text.split()
        self.n_symbols = len(raw_text) - len(raw_text.translate(None, SYMBOLS))
        marks = self.n_symbols > 1 or any(c in raw_text for c in (b"!!", b"!?", b"?!", b"??"))
        separators = any(c.encode() in raw_text for c in SEPARATORS)
        self.n_words = len(words)
        self.word_chars = len(raw_text.translate(None, NO_CHARACTER))
        self.n_repeat_words = in_repeated_windows(words)
        self.n_dup_lines = self.n_failed_lines = self.n_lost_words = 0
        self.lines, seen = [], set()
        for line in raw_text.split(b"\n"):
            inside = line.split()
            if inside:
                self.n_dup_lines += line in seen
                seen.add(line)
            if not inside or broken_rule(line.decode(), inside, marks, separators) is None:
                self.lines.append(line)
            else:
                self.n_failed_lines += 1
                self.n_lost_words += len(inside)
        self.base_failed = self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > REPEATED * self.n_words
        self.kept = not self.base_failed and 100 * self.n_lost_words <= LOST * self.n_words


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", "n_lost_words")
VERDICTS = ("base_failed", "kept")


def line_report(docs: DataFrame) -> DataFrame:
    """Per document its counts, what the lines' rules take away, and the verdict."""
    def judged(batch: pa.RecordBatch) -> dict:
        them = [Judged(t) for t in raw(batch)]
        return {"doc_id": batch.column("doc_id").cast(pa.int64())} | {c: [getattr(x, c) for x in them] for c in COUNTS + VERDICTS}
    schema = ["doc_id long", *(f"{c} long" for c in COUNTS), *(f"{c} boolean" for c in VERDICTS)]
    return per_batch(docs.select("doc_id", "text"), judged, ",".join(schema))


def cleaned(docs: DataFrame) -> DataFrame:
    """The kept documents without their failing lines, in all columns that ``docs`` has."""
    schema = StructType([StructField("row", docs.schema), StructField("left", StringType()), StructField("stays", BooleanType())])

    def batches(them):
        for batch in them:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                judged = [Judged(t) for t in raw(part)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([b"\n".join(x.lines).decode() if x.kept else None for x in judged], pa.string()),
                     pa.array([x.kept for x in judged], pa.bool_())], names=schema.names)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return (docs.select(row, F.col("text")).mapInArrow(batches, schema).filter("stays")
            .select(*((F.col("left") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns)))
