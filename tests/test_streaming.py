"""However a stream is cut into files, and wherever it stops, it ends where the batch does."""

import os
import random

import pytest

import quillgrid.operators.hitters as h
from conftest import MIDDLE
from quillgrid import queries as q
from quillgrid.streaming import items as streams
from quillgrid.streaming import keyed, tables

F5000 = h.Frequency(5000, 0.008, 0.002, 0.1)
JOBS = {
    "histogram": (streams.stream_histogram, streams.read_histogram, h.histogram),
    "reservoir": (streams.stream_reservoir, streams.read_reservoir, h.reservoir),
    "sticky": (streams.stream_sticky, streams.read_sticky, h.sticky),
}


def feed(spark, folder, part, parts):
    """Write one of ``parts`` consecutive pieces of the events as a file of its own."""
    size = -(-10000 // parts)
    piece = spark.read.parquet(f"{MIDDLE}/events.parquet").filter(
        f"event_id >= {part * size} and event_id < {(part + 1) * size}")
    piece.coalesce(1).write.mode("append").parquet(folder)


def run(spark, job, folder, to, checkpoint, f=F5000):
    source = streams.read_items(spark, folder, "user_id", "event_id", files_per_batch=1)
    job(source, f, to, checkpoint).awaitTermination()


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("name", JOBS)
def test_stream_equals_batch(spark, tmp_path, name, parts):
    start, read, batch = JOBS[name]
    folder, to, checkpoint = (str(tmp_path / d) for d in ("in", "out", "progress"))
    want = sorted(batch(q.event_items(spark, MIDDLE), F5000).collect())
    half = -(-parts // 2)
    for part in range(half):
        feed(spark, folder, part, parts)
    run(spark, start, folder, to, checkpoint)
    for part in range(half, parts):
        feed(spark, folder, part, parts)
    run(spark, start, folder, to, checkpoint)  # a new query from the checkpoint
    assert sorted(read(spark, to).collect()) == want


def test_repeated_batch_changes_nothing(spark, tmp_path):
    """A batch that is run again overwrites what it wrote."""
    folder, to = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark, folder, 0, 1)
    for name in ("first", "again"):  # a lost checkpoint repeats batch 0
        run(spark, streams.stream_sticky, folder, to, str(tmp_path / name))
        got = sorted(streams.read_sticky(spark, to).collect())
        assert got == sorted(h.sticky(q.event_items(spark, MIDDLE), F5000).collect())


def test_nothing_arrived_in_time(spark, tmp_path):
    folder, to = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark, folder, 1, 2)  # arrivals from 5000 on: all beyond n
    for name, (start, read, _) in JOBS.items():
        run(spark, start, folder, to + name, str(tmp_path / name))
        assert read(spark, to + name).count() == 0


def _all_three(spark, folder, to, checkpoint, f=F5000):
    source = streams.read_items(spark, folder, "user_id", "event_id", files_per_batch=1)
    query = streams.stream_summaries(source, f, to, checkpoint)
    query.awaitTermination()
    return query


@pytest.mark.parametrize("parts, bits", [(1, 16), (2, 4), (7, 9)])
def test_one_stream_keeps_all_three(spark, tmp_path, monkeypatch, parts, bits):
    """Whatever the blocks, the files and the restarts."""
    monkeypatch.setattr(keyed, "BLOCK_BITS", bits)
    folder, to, checkpoint = (str(tmp_path / d) for d in ("in", "out", "progress"))
    want = [sorted(job(q.event_items(spark, MIDDLE), F5000).collect()) for job in (h.histogram, h.reservoir, h.sticky)]
    for part in range(parts):
        feed(spark, folder, part, parts)
        if part in (0, parts - 1):
            _all_three(spark, folder, to, checkpoint)
    assert [sorted(df.collect()) for df in streams.read_summaries(spark, to)] == want


def _rows(spark, table):
    return {k: spark.read.parquet(tables.partition(table, k)).count() for k in tables.finished(spark, table)}


def test_a_batch_writes_what_it_counted(spark, tmp_path):
    """A batch of few items writes few rows, however many are tracked."""
    folder, to, checkpoint = (str(tmp_path / d) for d in ("in", "out", "progress"))
    everything = h.Frequency(100_000, 0.008, 0.002, 0.1)       # all that fits is tracked soon
    feed(spark, folder, 0, 1)
    spark.createDataFrame([(10_000 + k, k % 2) for k in range(5000)], "event_id long, user_id long").coalesce(1).write.mode("append").parquet(folder)
    run(spark, streams.stream_sticky, folder, to, checkpoint, everything)
    rows = _rows(spark, to)
    assert rows[0] > 100 and rows[1] == 2
    batch = spark.read.parquet(folder).selectExpr("event_id as arrival", "user_id as item")
    assert sorted(streams.read_sticky(spark, to).collect()) == sorted(h.sticky(batch, everything).collect())


@pytest.mark.parametrize("bits", [3, 16])
def test_rows_of_a_batch_in_any_order_and_a_hot_item(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(keyed, "BLOCK_BITS", bits)
    folder, to = str(tmp_path / "in"), str(tmp_path / "out")
    f = h.Frequency(3000, 0.05, 0.04, 0.5)                      # a rate of about 3 per cent
    rows = [(k, 7 if k % 3 else k % 50) for k in range(3500)]
    late, early = rows[1800:], rows[:1800]
    for part in (early, late):
        df = spark.createDataFrame(random.Random(2).sample(part, len(part)), "event_id long, user_id long").repartition(1)
        df.write.mode("append").parquet(folder)
    run(spark, streams.stream_sticky, folder, to, str(tmp_path / "progress"), f)
    batch = spark.createDataFrame(rows, "arrival long, item long")
    assert sorted(streams.read_sticky(spark, to).collect()) == sorted(h.sticky(batch, f).collect())


def test_an_arrival_without_an_item(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(0, 1), (1, None)], "event_id long, user_id long").write.parquet(folder)
    with pytest.raises(Exception, match="without a number or an item"):
        run(spark, streams.stream_sticky, folder, str(tmp_path / "out"), str(tmp_path / "progress"))


def test_arrivals_that_go_back(spark, tmp_path):
    folder, to, checkpoint = (str(tmp_path / d) for d in ("in", "out", "progress"))
    feed(spark, folder, 1, 4)
    run(spark, streams.stream_sticky, folder, to, checkpoint)
    feed(spark, folder, 0, 4)
    with pytest.raises(Exception, match="came after"):
        run(spark, streams.stream_sticky, folder, to, checkpoint)


def test_tables_stay_small(spark, tmp_path):
    """Many batches leave few partitions, and the same results."""
    folder = str(tmp_path / "in")
    for part in range(12):
        feed(spark, folder, part, 12)
    for name, (start, read, batch) in JOBS.items():
        to = str(tmp_path / name)
        source = streams.read_items(spark, folder, "user_id", "event_id", files_per_batch=1)
        start(source, F5000, to, str(tmp_path / f"{name}-progress"), compacted=4).awaitTermination()
        assert len(tables.finished(spark, to)) <= 5
        assert sorted(read(spark, to).collect()) == sorted(batch(q.event_items(spark, MIDDLE), F5000).collect())


def test_a_partition_without_its_mark_does_not_count(spark, tmp_path):
    folder, to = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark, folder, 0, 1)
    run(spark, streams.stream_sticky, folder, to, str(tmp_path / "progress"))
    want = sorted(streams.read_sticky(spark, to).collect())
    spark.createDataFrame([(1, 999)], streams.STICKY).write.parquet(tables.partition(to, 7))
    (tmp_path / "out" / "batch_id=7" / "_SUCCESS").unlink()
    assert sorted(streams.read_sticky(spark, to).collect()) == want


def _lines(folder, files, rows):
    folder.mkdir(exist_ok=True)
    for k in range(files):
        path = folder / f"part-{k}.txt"
        path.write_text("".join(f"{(7 * i) % 13}\n" for i in range(rows) if i * files // rows == k))
        os.utime(path, (1000 + k, 1000 + k))  # files are taken in order of their age


@pytest.mark.parametrize("per_batch", [1, 3, 7])
def test_text_items_are_numbered(spark, tmp_path, per_batch):
    _lines(tmp_path / "in", 7, 100)
    to = str(tmp_path / "out")
    lines = streams.read_lines(spark, str(tmp_path / "in"), files_per_batch=per_batch)
    streams.numbered(lines, to, str(tmp_path / "progress")).awaitTermination()
    want = [(i, (7 * i) % 13) for i in range(100)]
    assert sorted(map(tuple, streams.read_numbered(spark, to).collect())) == want
    short = str(tmp_path / "short")
    streams.numbered(lines, short, str(tmp_path / "short-progress"), n=33).awaitTermination()
    assert sorted(map(tuple, streams.read_numbered(spark, short).collect())) == want[:33]


def _counted_reads(monkeypatch):
    """How many earlier partitions each batch looks at."""
    reads, plain = [], tables.read

    def read(spark, table, schema, batch_ids=None):
        if table.endswith(streams.ENDS):
            reads.append(batch_ids)
        return plain(spark, table, schema, batch_ids)
    monkeypatch.setattr(tables, "read", read)
    return reads


def test_a_batch_reads_one_earlier_row_however_many_there_were(spark, tmp_path, monkeypatch):
    _lines(tmp_path / "in", 40, 80)
    to, reads = str(tmp_path / "out"), _counted_reads(monkeypatch)
    query = streams.numbered(streams.read_lines(spark, str(tmp_path / "in"), files_per_batch=1), to, str(tmp_path / "progress"))
    query.awaitTermination()
    assert reads[:39] == [[k] for k in range(39)]
    assert len(tables.finished(spark, f"{to}/{streams.ENDS}")) == 2 and streams.arrived(spark, to) == 80
    assert sorted(map(tuple, streams.read_numbered(spark, to).collect())) == [(i, (7 * i) % 13) for i in range(80)]


def test_numbering_by_position_in_the_source(spark, tmp_path):
    """Rows of several partitions of a topic, as a queue gives them."""
    rows = [(topic, part, offset, 100 * part + offset) for topic in ("a", "b") for part in (1, 0) for offset in (2, 0, 1)]
    folder, to = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "topic string, partition int, offset long, value long"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    order = ("topic", "partition", "offset")
    streams.numbered(streams.read_positions(stream, "value", *order), to, str(tmp_path / "p"), order=order).awaitTermination()
    assert [r.item for r in streams.read_numbered(spark, to).orderBy("arrival").collect()] == [r[3] for r in sorted(rows)]


def test_numbering_goes_on_after_a_restart_and_repeats_a_batch(spark, tmp_path):
    _lines(tmp_path / "in", 3, 30)
    to, read = str(tmp_path / "out"), lambda: streams.read_lines(spark, str(tmp_path / "in"), files_per_batch=1)
    streams.numbered(read(), to, str(tmp_path / "first")).awaitTermination()
    want = sorted(map(tuple, streams.read_numbered(spark, to).collect()))
    (tmp_path / "in" / "late.txt").write_text("5\n6\n")
    streams.numbered(read(), to, str(tmp_path / "first")).awaitTermination()
    assert sorted(map(tuple, streams.read_numbered(spark, to).collect())) == want + [(30, 5), (31, 6)]
    # the last batch failed before its end was written
    tables.drop(spark, f"{to}/{streams.ENDS}", [3])
    assert streams.arrived(spark, to) == 30
    (tmp_path / "first" / "commits" / "3").unlink()
    (tmp_path / "first" / "commits" / ".3.crc").unlink(missing_ok=True)
    streams.numbered(read(), to, str(tmp_path / "first")).awaitTermination()
    assert sorted(map(tuple, streams.read_numbered(spark, to).collect())) == want + [(30, 5), (31, 6)] and streams.arrived(spark, to) == 32


def test_a_running_stream_stops_after_n(spark, tmp_path):
    _lines(tmp_path / "in", 3, 60)
    to = str(tmp_path / "out")
    lines = streams.read_lines(spark, str(tmp_path / "in"), files_per_batch=1)
    query = streams.numbered(lines, to, str(tmp_path / "progress"), n=30, trigger={"processingTime": "0 seconds"})
    streams.until(query, lambda: streams.arrived(spark, to), 30)
    assert not query.isActive and streams.read_numbered(spark, to).count() == 30


def test_a_line_that_is_no_number(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1\nx\n")
    with pytest.raises(Exception, match="no whole number"):
        streams.numbered(streams.read_lines(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "p")).awaitTermination()
