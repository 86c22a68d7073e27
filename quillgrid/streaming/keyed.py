"""Keyed state of the frequent-item streams, fed with sums over blocks of arrivals.

Arrivals are dealt by blocks of consecutive numbers, so tasks are even whatever the items are. Each
task sums up its blocks: for an item and a block the rows, the first one whose draw makes the item
tracked, and the rows from there on. Only these sums go to the state of their item: an item that makes
up a third of the stream brings one row for each block. As a block is summed in one task, its sums
are exact in whatever order rows come within a batch.

Rows are ``kind, key, block, n, rest``:

* ``ITEM``: rows of item ``key`` in ``block``, and those from the first drawn one on (null if none is);
* ``SLOT``: the last arrival ``block`` that took over slot ``key`` of the reservoir, and its item ``n``;
* ``ORDER``: the first (``block``) and the last (``n``) arrival of a task; one key for the whole stream, whose
  state is the last arrival, so that arrivals that go back across batches stop the query.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillgrid.operators.hitters import TRACK, Frequency, draw, entered, first_arrivals

ITEM, SLOT, ORDER = 0, 1, 2
BLOCK_BITS = 16
SUMS = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("rest", pa.int64())])


def _item_sums(arrival: np.ndarray, block: np.ndarray, item: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
    """One row for each item and block of some whole blocks."""
    order = np.lexsort((arrival, block, item))
    item, block, hit = item[order], block[order], hit[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (block[1:] != block[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(item))
    # the place of the first drawn row of each run
    place = np.where(hit, np.arange(len(item)), len(item))
    first = np.minimum.reduceat(place, start) if len(start) else start
    drawn = first < end
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(start), ITEM, np.int32)), pa.array(item[start]), pa.array(block[start]), pa.array(end - start),
        pa.array(np.where(drawn, end - first, 0), mask=~drawn)], schema=SUMS)


def _slot_sums(slot: np.ndarray, arrival: np.ndarray, item: np.ndarray) -> pa.RecordBatch:
    """The last arrival of each slot."""
    order = np.lexsort((arrival, slot))
    slot, arrival, item = slot[order], arrival[order], item[order]
    last = np.ones(len(slot), bool)
    last[:-1] = slot[1:] != slot[:-1]
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(int(last.sum()), SLOT, np.int32)), pa.array(slot[last]), pa.array(arrival[last]), pa.array(item[last]),
        pa.array([None] * int(last.sum()), pa.int64())], schema=SUMS)


def sums(stream: DataFrame, f: Frequency, slots: bool) -> DataFrame:
    """The sums of the first ``n`` arrivals of each micro-batch, with those of the reservoir if asked for."""
    bits = BLOCK_BITS
    rows = first_arrivals(stream, f.n).withColumn("hit", draw(TRACK) <= F.lit(f.rate))
    rows = rows.withColumn("slot", entered(f) if slots else F.lit(None).cast("long"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        if table.column("item").null_count or table.column("arrival").null_count:
            raise ValueError("an arrival without a number or an item")
        arrival, item, hit = (table.column(c).to_numpy() for c in ("arrival", "item", "hit"))
        yield _item_sums(arrival, arrival >> bits, item, hit)
        took = table.column("slot").is_valid().to_numpy()
        if took.any():
            yield _slot_sums(table.column("slot").drop_null().to_numpy(), arrival[took], item[took])
        yield pa.RecordBatch.from_pylist([{"kind": ORDER, "key": 0, "block": int(arrival.min()), "n": int(arrival.max())}], schema=SUMS)
    dealt = rows.repartition(F.shiftright("arrival", bits))
    return dealt.mapInArrow(summed, "kind int, key long, block long, n long, rest long")


def _tracked(before: int | None, rows: pd.DataFrame) -> int | None:
    """The sticky count of an item after the sums of a batch; None while it is not tracked."""
    if before is not None:
        return before + int(rows["n"].sum())
    drawn = rows[rows["rest"].notna()]
    if drawn.empty:
        return None
    first = drawn.loc[drawn["block"].idxmin()]
    return int(first["rest"]) + int(rows.loc[rows["block"] > first["block"], "n"].sum())


def _in_order(state: GroupState, rows: pd.DataFrame, width: int) -> None:
    low, high = int(rows["block"].min()), int(rows["n"].max())
    if state.exists and low <= state.get[0]:
        raise ValueError(f"arrival {low} came after arrival {state.get[0]}")
    state.update((high,) * width)


def _stateful(rows: DataFrame, step: Callable, out: str, state: str) -> DataFrame:
    return rows.groupBy("kind", "key").applyInPandasWithState(step, out, state, "update", GroupStateTimeout.NoTimeout)


def sticky_updates(stream: DataFrame, f: Frequency) -> DataFrame:
    """``item, n`` of the tracked items that a micro-batch counted; the state is one number for each of them."""
    def step(key, frames, state):
        rows = pd.concat(frames)
        if key[0] == ORDER:
            _in_order(state, rows, 1)
            return
        n = _tracked(state.get[0] if state.exists else None, rows)
        if n is not None:
            state.update((n,))
            yield pd.DataFrame({"item": [key[1]], "n": [n]})
    return _stateful(sums(stream, f, slots=False), step, "item long, n long", "n long")


UNTRACKED = -1


def summary_updates(stream: DataFrame, f: Frequency) -> DataFrame:
    """``kind, key, a, b`` of all that a micro-batch changed, from one pass over it.

    For an item ``a`` is its count and ``b`` its sticky count (``UNTRACKED`` if it has none); for a slot of the
    reservoir ``a`` is its item and ``b`` the arrival that brought it.
    """
    def step(key, frames, state):
        kind, rows = key[0], pd.concat(frames)
        if kind == ORDER:
            _in_order(state, rows, 2)
            return
        a, b = state.get if state.exists else (0, UNTRACKED)
        if kind == ITEM:
            n = _tracked(None if b == UNTRACKED else b, rows)
            a, b = a + int(rows["n"].sum()), UNTRACKED if n is None else n
        else:
            last = rows.loc[rows["block"].idxmax()]
            if int(last["block"]) <= b:
                return
            a, b = int(last["n"]), int(last["block"])
        state.update((a, b))
        yield pd.DataFrame({"kind": [kind], "key": [key[1]], "a": [a], "b": [b]})
    return _stateful(sums(stream, f, slots=True), step, "kind int, key long, a long, b long", "a long, b long")
