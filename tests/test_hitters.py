import hashlib
import random

import pytest

import quillgrid.operators.hitters as h
from conftest import MIDDLE
from quillgrid import queries as q
from quillgrid.sources.items import number_arrivals


def uniform(salt, arrival):
    return int(hashlib.md5(f"{salt}{arrival}".encode()).hexdigest()[:8], 16) / 2 ** 32


def replay(stream, f):
    """The three structures after the arrivals were taken one at a time."""
    counts, sample, table = {}, {}, {}
    for t, item in enumerate(stream[:f.n]):
        counts[item] = counts.get(item, 0) + 1
        if t < f.sample_size:
            sample[t] = item
        elif uniform("a", t) <= f.sample_size / (t + 1):
            sample[int(uniform("b", t) * f.sample_size)] = item
        if item in table or uniform("c", t) <= f.rate:
            table[item] = table.get(item, 0) + 1
    return counts, sample, table


def skewed(seed, size):
    rnd = random.Random(seed)
    return [0 if rnd.random() < 0.35 else rnd.randint(1, 40) for _ in range(size)]


@pytest.fixture(scope="session")
def arriving(spark):
    def build(stream):
        rows = list(enumerate(stream))
        random.Random(1).shuffle(rows)
        return spark.createDataFrame(rows, "arrival long, item long").repartition(4)
    return build


SETTINGS = {
    "plain": h.Frequency(600, 0.05, 0.03, 0.1),
    "stream longer than n": h.Frequency(250, 0.1, 0.05, 0.5),
    "stream shorter than n": h.Frequency(900, 0.05, 0.03, 0.1),
    "all tracked": h.Frequency(200, 0.02, 0.01, 0.01),
    "epsilon above phi": h.Frequency(600, 0.05, 0.2, 0.1),
    "sample above n": h.Frequency(30, 0.01, 0.2, 0.4),
}


@pytest.mark.parametrize("name", SETTINGS)
def test_against_replay(arriving, name, monkeypatch):
    f, stream = SETTINGS[name], skewed(3, 600)
    df = arriving(stream)
    counts, sample, table = replay(stream, f)
    truth = sorted(i for i, n in counts.items() if n / f.n >= f.phi)
    guessed = sorted(i for i, n in table.items() if n >= f.boundary)
    assert {r.item: r.n for r in h.histogram(df, f).collect()} == counts
    assert [r.item for r in h.frequent_exact(df, f).collect()] == truth
    assert {r.slot: r.item for r in h.reservoir(df, f).collect()} == sample
    assert [r.item for r in h.frequent_reservoir(df, f).collect()] == sorted(set(sample.values()))
    assert {r.item: r.n for r in h.sticky(df, f).collect()} == table
    assert [r.item for r in h.frequent_sticky(df, f).collect()] == guessed
    assert all(n <= counts[i] for i, n in table.items())
    flags = {(r.method, r.item): r.is_true for r in h.frequent_flags(df, f).collect()}
    assert flags == {("reservoir", i): i in truth for i in sample.values()} | {
        ("sticky", i): i in truth for i in guessed}
    want = (len(counts), len(truth), len(sample), len(set(sample.values())), len(table), len(guessed),
            f.sample_size, f.tracked, f.rate)
    assert tuple(h.report(df, f).first()) == want
    # tables too large to broadcast
    monkeypatch.setattr(h, "BROADCAST_TRACKED", 0)
    monkeypatch.setattr(h, "BLOCK_BITS", 5)
    assert {r.item: r.n for r in h.sticky(df, f).collect()} == table
    assert tuple(h.report(df, f).first()) == want


def test_golden_numbers(spark):
    v = q.event_items(spark, MIDDLE)
    f = h.Frequency(5000, 0.008, 0.002, 0.1)
    assert (f.sample_size, f.tracked, f.rate) == (125, 3565.449415148173, 0.7130898830296346)
    r = h.report(v, f).first()
    assert (r.histogram_items, r.true_items) == (150, 23)
    assert (r.reservoir_rows, r.reservoir_estimates) == (125, 81)
    assert (r.sticky_items, r.sticky_estimates) == (150, 110)
    hits = {m: n for m, n in h.frequent_flags(v, f).filter("is_true").groupBy("method").count().collect()}
    assert hits == {"reservoir": 17, "sticky": 23}


def test_prefix_reaches_the_scan(spark):
    plan = h.first_arrivals(q.event_items(spark, MIDDLE), 70)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(event_id,70)" in plan and "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


def test_numbering_arrivals(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 3), k, rnd.randint(0, 9)) for k in range(300)]
    df = spark.createDataFrame(rows, "hour long, key long, item long").repartition(7)
    got = {r.arrival: r.item for r in number_arrivals(df, "item", ["hour", "key"]).collect()}
    assert got == dict(enumerate(item for _, _, item in sorted(rows)))


@pytest.mark.parametrize("n, phi, epsilon, delta", [
    (0, 0.1, 0.1, 0.1), (5, 0, 0.1, 0.1), (5, 1, 0.1, 0.1), (5, 0.1, 1.5, 0.1), (5, 0.1, 0.1, -1), (5.0, 0.1, 0.1, 0.1)])
def test_bad_arguments(n, phi, epsilon, delta):
    with pytest.raises(ValueError):
        h.Frequency(n, phi, epsilon, delta)
