"""Text quality by ordinal cumulative-link regression on graded ratings.

Ratings here: 0 for poor text, 1 for good but toxic text, 2 for good text. Features are
the shares of hashed words, of word shapes, and of words said twice in a row. The expected grade ranks texts, and the
probability of a grade of at least ``GOOD`` selects them.

Nulls: a null or empty text has no features; its grade follows from the thresholds alone.
A null label rates nothing. Rows that repeat get the same grade each.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import ordinal
from quillgrid.llm.text import kept_rows, per_batch, raw

GRADES, GOOD, LEAST = 3, 1, 0.5
CACHED = 100_000                # words a worker keeps; time only

_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b > 127 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


class _Slots(dict):
    """Slot of a word in the upper half, of its shape in the lower."""

    def __missing__(self, word: bytes) -> int:
        shape = _RUN.sub(rb"\1", word.translate(_SHAPE))[:16]
        slot = lambda b, seed: xxhash.xxh64_intdigest(b, seed) % ordinal.DIMENSIONS
        self[word] = made = slot(word.lower(), 1) << 32 | slot(shape, 2)
        return made


_SLOTS = _Slots()
#: Slot of a word that repeats the one before.
AGAIN = xxhash.xxh64_intdigest(b"", 3) % ordinal.DIMENSIONS


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of the shares of words and of shapes."""
    if len(_SLOTS) > CACHED:
        _SLOTS.clear()
    words = text.split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    both = np.fromiter(map(_SLOTS.__getitem__, words), np.int64, len(words))
    again = np.full(np.count_nonzero(both[1:] == both[:-1]), AGAIN)
    slots, n = np.unique(np.concatenate([both >> 32, both & 0xFFFFFFFF, again]), return_counts=True)
    return slots.astype(np.int32), np.sqrt(n / len(words)).astype(np.float32)


def ratings(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` from flags ``quality`` and ``toxic``; a missing ``toxic`` counts as not toxic."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality").isNotNull(), 2)
    return labels.select("doc_id", grade.alias("grade"))


def model(docs: DataFrame, labels: DataFrame, rows: int = ordinal.FIT_ROWS) -> ordinal.Model:
    return ordinal.trained(docs, ratings(labels), features, GRADES, rows)


def graded(docs: DataFrame, fitted: ordinal.Model, good: int = GOOD, least: float = LEAST) -> DataFrame:
    """``doc_id, expected_grade, p_good, kept`` of each row."""
    def scored(batch: pa.RecordBatch) -> dict:
        above = np.array([fitted.above(*features(t)) for t in raw(batch)]).reshape(-1, len(fitted.thresholds))
        return {"doc_id": batch.column("doc_id").cast(pa.int64()), "expected_grade": above.sum(axis=1),
                "p_good": above[:, good - 1], "kept": above[:, good - 1] >= least}
    return per_batch(docs.select("doc_id", "text"), scored, "doc_id long,expected_grade double,p_good double,kept boolean")


def selected(docs: DataFrame, fitted: ordinal.Model, good: int = GOOD, least: float = LEAST) -> DataFrame:
    """The documents whose tail probability is high enough, as they are."""
    return kept_rows(docs, lambda text: bool(fitted.above(*features(text))[good - 1] >= least))
