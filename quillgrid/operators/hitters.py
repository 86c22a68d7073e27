"""Frequent items among the first ``n`` arrivals: exact, by reservoir, by sticky sampling.

Streams are ``(arrival, item)`` with arrivals counted from 0. ``first_arrivals``,
``histogram`` and ``reservoir`` take a batch or a streaming frame alike.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.functions import checks, rng

ACCEPT, SLOT, TRACK = "a", "b", "c"  # salts of the three draws of an arrival

# The items tracked are at most the arrivals drawn with probability r/n, so about r of
# them whatever n is. Up to this r (24 bytes each) they are sent to every executor.
BROADCAST_TRACKED = 1_000_000
BLOCK_BITS = 20                      # arrivals per block beyond that


@dataclass(frozen=True)
class Frequency:
    """Which items are frequent: at least ``phi * n`` of the first ``n`` arrivals."""

    n: int
    phi: float
    epsilon: float
    delta: float

    def __post_init__(self):
        checks.whole("n", self.n, 1)
        for name in ("phi", "epsilon", "delta"):
            checks.share(name, getattr(self, name))

    @property
    def sample_size(self) -> int:
        return math.ceil(1 / self.phi)

    @property
    def tracked(self) -> float:
        return math.log(1 / (self.phi * self.delta)) / self.epsilon

    @property
    def rate(self) -> float:
        """Chance that an arrival makes its item tracked; from 1 on, all are."""
        return self.tracked / self.n

    @property
    def boundary(self) -> float:
        return (self.phi - self.epsilon) * self.n


def draw(salt: str) -> Column:
    return rng.uniform(F.col("arrival"), salt)


def first_arrivals(stream: DataFrame, n: int) -> DataFrame:
    """Exactly the first ``n`` arrivals, however they are cut into batches."""
    return stream.filter(F.col("arrival") < checks.whole("n", n, 1)).select("arrival", "item")


def histogram(stream: DataFrame, f: Frequency) -> DataFrame:
    return first_arrivals(stream, f.n).groupBy("item").agg(F.count("*").alias("n"))


def is_frequent(n: Column, f: Frequency) -> Column:
    return n / F.lit(f.n) >= F.lit(f.phi)


def frequent(counts: DataFrame, f: Frequency) -> DataFrame:
    """The frequent rows of a histogram; never more than 1/phi."""
    return counts.filter(is_frequent(F.col("n"), f))


def frequent_exact(stream: DataFrame, f: Frequency) -> DataFrame:
    """The frequent items with their counts, ascending."""
    return frequent(histogram(stream, f), f).orderBy("item")


def reservoir(stream: DataFrame, f: Frequency) -> DataFrame:
    """A sample of the arrivals, as ``(slot, item, arrival)``.

    The first m arrivals take a slot each. Arrival t > m enters with chance m/t and
    takes over a random slot. As draws depend on the arrival alone, the sample is the
    last arrival of each slot: only about m*ln(n/m) accepted rows are aggregated.
    """
    kept = first_arrivals(stream, f.n).withColumn("slot", entered(f)).filter("slot is not null")
    return kept.groupBy("slot").agg(F.max_by("item", "arrival").alias("item"), F.max("arrival").alias("arrival"))


def entered(f: Frequency) -> Column:
    """The slot of the reservoir that an arrival takes, null if it does not enter."""
    m, t = F.lit(f.sample_size), F.col("arrival")
    return F.when(t < m, t).when(draw(ACCEPT) <= m / (t + 1), F.floor(draw(SLOT) * m))


def sampled(sample: DataFrame) -> DataFrame:
    """The estimate a reservoir makes: its distinct items, however often they occur."""
    return sample.select("item").distinct()


def frequent_reservoir(stream: DataFrame, f: Frequency) -> DataFrame:
    return sampled(reservoir(stream, f)).orderBy("item")


def first_tracked(arrivals: DataFrame, f: Frequency) -> DataFrame:
    """``(item, first)``: the arrival from which each tracked item is counted."""
    return (arrivals.filter(draw(TRACK) <= F.lit(f.rate))
            .groupBy("item").agg(F.min("arrival").alias("first")))


def is_bounded(f: Frequency) -> bool:
    return f.tracked <= BROADCAST_TRACKED


def bounded(tracked: DataFrame, f: Frequency) -> DataFrame:
    return F.broadcast(tracked) if is_bounded(f) else tracked


def by_blocks(arrivals: DataFrame, f: Frequency) -> DataFrame:
    """Sticky counts for tables too large to broadcast.

    An item is ranked within blocks of consecutive arrivals, so one that makes up a
    third of the stream is spread over as many tasks as there are blocks.
    """
    where = F.shiftright("arrival", BLOCK_BITS)
    nth = F.row_number().over(W.partitionBy("item", "block").orderBy("arrival"))
    blocks = (
        arrivals.select("item", "arrival", where.alias("block"), (draw(TRACK) <= F.lit(f.rate)).alias("hit"))
        .withColumn("nth", nth)
        .groupBy("item", "block")
        .agg(F.count("*").alias("n"), F.min(F.when(F.col("hit"), F.col("nth"))).alias("nth")))
    start = (blocks.filter("nth is not null")
             .withColumn("rest", F.col("n") - F.col("nth") + 1)
             .groupBy("item").agg(F.min(F.struct("block", "rest")).alias("start")))
    later = F.when(F.col("block") > F.col("start.block"), F.col("n")).otherwise(F.lit(0))
    return (blocks.join(start, "item").groupBy("item")
            .agg((F.sum(later) + F.max("start.rest")).alias("n")))


def sticky(stream: DataFrame, f: Frequency) -> DataFrame:
    """Sticky sampling: ``(item, n)``, arrivals from the one on that made the item tracked."""
    if f.rate >= 1:
        return histogram(stream, f)
    arrivals = first_arrivals(stream, f.n)
    if not is_bounded(f):
        return by_blocks(arrivals, f)
    return (arrivals.join(bounded(first_tracked(arrivals, f), f), "item").filter("arrival >= first")
            .groupBy("item").agg(F.count("*").alias("n")))


def above_boundary(tallies: DataFrame, f: Frequency) -> DataFrame:
    """The estimate of a sticky table: rows with a count of at least (phi - epsilon) n."""
    return tallies.filter(F.col("n") >= F.lit(f.boundary))


def frequent_sticky(stream: DataFrame, f: Frequency) -> DataFrame:
    return above_boundary(sticky(stream, f), f).orderBy("item")


def flags(counts: DataFrame, sample: DataFrame, tallies: DataFrame, f: Frequency) -> DataFrame:
    """``(method, item, is_true)``: which estimates are frequent indeed.

    Takes a histogram, a reservoir and a sticky table, from a batch or left by streams.
    """
    def named(df, method):
        return df.select(F.lit(method).alias("method"), "item")
    estimates = named(sampled(sample), "reservoir").unionByName(
        named(above_boundary(tallies, f), "sticky"))
    # at most 1/phi rows
    truth = F.broadcast(frequent(counts, f).select("item", F.lit(True).alias("found")))
    return estimates.join(truth, "item", "left").select(
        "method", "item", F.col("found").isNotNull().alias("is_true"))


def sizes(counts: DataFrame, sample: DataFrame, tallies: DataFrame, f: Frequency) -> DataFrame:
    """Sizes of the three structures and the number of answers of each, in one row."""
    parts = [
        counts.agg(F.count("*").alias("histogram_items"),
                   F.count_if(is_frequent(F.col("n"), f)).alias("true_items")),
        sample.agg(F.count("*").alias("reservoir_rows"),
                   F.count_distinct("item").alias("reservoir_estimates")),
        tallies.agg(F.count("*").alias("sticky_items"),
                    F.count_if(F.col("n") >= F.lit(f.boundary)).alias("sticky_estimates")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*(F.sum(c).alias(c) for c in rows.columns)).select(
        "*", F.lit(f.sample_size).cast("long").alias("m"), F.lit(f.tracked).alias("r"),
        F.lit(f.rate).alias("rate"))


def frequent_flags(stream: DataFrame, f: Frequency) -> DataFrame:
    return flags(histogram(stream, f), reservoir(stream, f), sticky(stream, f), f)


def report(stream: DataFrame, f: Frequency) -> DataFrame:
    return sizes(histogram(stream, f), reservoir(stream, f), sticky(stream, f), f)
