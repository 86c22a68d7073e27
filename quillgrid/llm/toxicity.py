"""Toxicity as severity grades by ordinal cumulative-link regression.

Labels only say toxic or not. Toxic texts are graded by how many tell-tale words they have:
words much more frequent among the toxic texts of the sample than among the others. Grade 0
is not toxic, 1 toxic, 2 toxic with more of them than the median toxic text. Features are
the hashed words present and their beginnings, as inflected words share a stem. One weight vector serves both thresholds; the expected severity
is the sum of the tail probabilities.

Nulls: a null or empty text has no features; its severity follows from the thresholds alone.
A null label says nothing. Rows that repeat get the same severity each.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import ordinal
from quillgrid.llm.text import per_batch, raw, words

GRADES, LEAST = 3, 0.5
CACHED = 100_000                # words a worker keeps; time only
BEGINNINGS = (3, 4, 5)          # characters of a word's beginnings that are features too
#: Tell-tale words: in at least so many toxic texts, and so many times the share of others.
SEEN, TIMES = 5, 8.0


class _Slots(dict):
    """Slots of a word and of its beginnings, as 32-bit integers."""

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        parts = [text[:k] + "*" for k in BEGINNINGS if len(text) >= k]
        slots = [xxhash.xxh64_intdigest(p.encode(), 3) % ordinal.DIMENSIONS for p in [text, *parts]]
        self[word] = made = np.array(slots, np.int32).tobytes()
        return made


_SLOTS = _Slots()


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    if len(_SLOTS) > CACHED:
        _SLOTS.clear()
    slots = np.unique(np.frombuffer(b"".join(map(_SLOTS.__getitem__, set(words(text)))), np.int32))
    return slots, np.ones(len(slots), np.float32)


def severities(slots: list[np.ndarray], _: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grades 0 to 2 from flags and the words present."""
    if not toxic.any():
        return toxic
    tally = lambda rows: np.bincount(np.concatenate([slots[k] for k in rows] or [np.empty(0, int)]), minlength=ordinal.DIMENSIONS)
    bad, good = np.flatnonzero(toxic), np.flatnonzero(toxic == 0)
    seen, others = tally(bad), tally(good)
    telling = (seen >= SEEN) & (seen / len(bad) > TIMES * (others + 1) / max(1, len(good)))
    n = np.array([telling[s].sum() for s in slots])
    return toxic + ((toxic == 1) & (n > np.median(n[bad])))


def model(docs: DataFrame, labels: DataFrame, rows: int = ordinal.FIT_ROWS) -> ordinal.Model:
    flags = labels.select("doc_id", (F.col("toxic") != 0).cast("int").alias("grade"))
    return ordinal.trained(docs, flags, features, GRADES, rows, severities)


def scored(docs: DataFrame, fitted: ordinal.Model, least: float = LEAST) -> DataFrame:
    """``doc_id, expected_severity, p_toxic, severity, toxic`` of each row."""
    def made(batch: pa.RecordBatch) -> dict:
        above = np.array([fitted.above(*features(t)) for t in raw(batch)]).reshape(-1, len(fitted.thresholds))
        return {"doc_id": batch.column("doc_id").cast(pa.int64()), "expected_severity": above.sum(axis=1),
                "p_toxic": above[:, 0], "severity": (above >= least).sum(axis=1).astype(np.int32), "toxic": above[:, 0] >= least}
    return per_batch(docs.select("doc_id", "text"), made,
                     "doc_id long,expected_severity double,p_toxic double,severity int,toxic boolean")
