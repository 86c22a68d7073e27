"""Cumulative-link regression: one weight vector for all grades, and ordered thresholds.

P(grade > k) = sigmoid(w.x - t_k) with t_0 < t_1 < ...; x are hashed sparse features. It is
fitted on a bounded sample of rated rows in one task, by proximal steps whose L1 term
leaves most weights at zero. Scores come from a pass over all rows, without a shuffle.
"""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.text import per_batch, raw

#: Rated rows that a model is fitted on at most: those whose ids have the smallest hashes.
FIT_ROWS = 8_000
DIMENSIONS = 1 << 18
STEPS, RATE, SPARSE = 300, 0.3, 3e-4
#: Rows of the sample that must have a feature for it to get a weight.
COMMON = 3

#: Slots of the features of a text, and their values.
Features = Callable[[bytes], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Model:
    """Weights and thresholds; without rated rows all are 0, and every probability is one half."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, slots: np.ndarray, values: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k."""
        return sigmoid(float(self.weights[slots] @ values) - self.thresholds)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _cuts(shape: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first one, and positive steps."""
    return np.cumsum(np.concatenate([shape[:1], np.exp(shape[1:])]))


def fit(slots: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, n_grades: int, dimensions: int = DIMENSIONS,
        steps: int = STEPS, rate: float = RATE, sparse: float = SPARSE) -> Model:
    """Maximise the mean log likelihood less ``sparse`` times the sum of absolute weights."""
    weights = np.zeros(dimensions)
    if not len(grades):
        return Model(weights.astype(np.float32), np.zeros(n_grades - 1))
    n = len(grades)
    tails = np.clip([(grades > k).mean() for k in range(n_grades - 1)], 1e-3, 1 - 1e-3)
    first = -np.log(tails / (1 - tails))
    shape = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    every = np.concatenate(slots)
    common = (np.bincount(every, minlength=dimensions) >= min(COMMON, n))[every]
    used = np.unique(every[common])
    place = np.zeros(dimensions, np.int32)
    place[used] = np.arange(len(used))
    column = place[every[common]]
    value = np.concatenate(values)[common]
    row = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in slots])[common]
    del every, common, place
    w, past, past_shape = np.zeros(len(used)), np.full(len(used), 1e-6), np.full(n_grades - 1, 1e-6)
    at = np.arange(n)
    for _ in range(steps):
        cuts = _cuts(shape)
        score = np.bincount(row, w[column] * value, n)
        above = np.column_stack([np.ones(n), sigmoid(score[:, None] - cuts), np.zeros(n)])
        a, b = above[at, grades], above[at, grades + 1]
        chance = np.maximum(a - b, 1e-9)
        gradient = -np.bincount(column, (1 - a - b)[row] * value, len(used)) / n
        on_cuts = np.zeros(n_grades + 1)
        np.add.at(on_cuts, grades, a * (1 - a) / chance / n)
        np.add.at(on_cuts, grades + 1, -b * (1 - b) / chance / n)
        tail = np.cumsum(on_cuts[1:-1][::-1])[::-1]
        on_shape = np.concatenate([tail[:1], tail[1:] * np.exp(shape[1:])])
        past += gradient ** 2
        past_shape += on_shape ** 2
        step = rate / np.sqrt(past)
        w -= step * gradient
        w = np.sign(w) * np.maximum(np.abs(w) - step * sparse, 0)
        shape -= rate / np.sqrt(past_shape) * on_shape
    weights[used] = w
    return Model(weights.astype(np.float32), _cuts(shape))


def sample(docs: DataFrame, rated: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, grade, text`` of at most ``rows`` rated documents; the lowest of several ratings, no rating that is null."""
    one = rated.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    few = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return (docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")       # at most `rows` of two numbers
            .groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("text").alias("text")))


def trained(docs: DataFrame, rated: DataFrame, features: Features, n_grades: int, rows: int = FIT_ROWS,
            regrade: Callable | None = None) -> Model:
    """A model of ``rated`` (``doc_id, grade``). ``regrade`` may refine the grades from the sample's features."""
    def extracted(batch: pa.RecordBatch) -> dict:
        made = [features(t) for t in raw(batch)]
        return {"doc_id": batch.column("doc_id").cast(pa.int64()), "grade": batch.column("grade").cast(pa.int32()), "slots": [s for s, _ in made], "values": [v for _, v in made]}

    def fitted(them):
        rows = []
        for batch in them:
            rows += zip(batch.column("doc_id").to_pylist(), batch.column("grade").to_pylist(),
                        (np.array(x, np.int32) for x in batch.column("slots").to_numpy(zero_copy_only=False)),
                        (np.array(x, np.float32) for x in batch.column("values").to_numpy(zero_copy_only=False)))
        rows.sort(key=lambda r: r[0])                # the same model however the rows arrive
        y, slots, values = np.array([r[1] for r in rows], np.int64), [r[2] for r in rows], [r[3] for r in rows]
        model = fit(slots, values, regrade(slots, values, y) if regrade else y, n_grades)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.thresholds.tobytes()])],
                                         names=["weights", "thresholds"])
    rows_of = per_batch(sample(docs, rated, rows), extracted, "doc_id long,grade int,slots array<int>,values array<float>")
    weights, thresholds = rows_of.repartition(1).mapInArrow(fitted, "weights binary, thresholds binary").first()
    return Model(np.frombuffer(weights, np.float32), np.frombuffer(thresholds))
