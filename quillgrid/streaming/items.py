"""Running the frequent-item operators as streams.

Each query keeps its result as a table in a folder shared by the executors, see
``tables``. Tables are exact however often a batch is repeated. Queries take a trigger:
by default they stop once the input at hand is used up, and resume from their
checkpoint; with another one they run on, and ``until`` stops them after n arrivals.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgrid.operators.hitters import Frequency, histogram, reservoir
from quillgrid.sources.items import items, number_arrivals, parse_items
from quillgrid.streaming import keyed, tables

ARRIVALS, HISTOGRAM, RESERVOIR = "arrival long, item long", "item long, n long", "slot long, item long, arrival long"
STICKY, SUMMARIES = HISTOGRAM, "kind int, key long, a long, b long"
TO_THE_END = {"availableNow": True}
COMPACTED = 20                             # partitions of an update table that are made one

#: Where a line stands in a stream of text files.
PLACE = {"path": "_metadata.file_path", "offset": "_metadata.file_block_start"}
ENDS, END = "_ends", "end long"            # beside the partitions of a numbered table: its length after each batch


def read_items(spark: SparkSession, folder: str, item: str, arrival: str, glob: str = "*.parquet",
               files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream of ``(arrival, item)``."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    return items(_reader(spark, glob, files_per_batch).schema(schema).parquet(folder), item, arrival)


def read_lines(spark: SparkSession, folder: str, glob: str = "*", files_per_batch: int | None = None) -> DataFrame:
    """Text files, one item per line, as ``(item, path, offset)``: for ``numbered``."""
    lines = _reader(spark, glob, files_per_batch).text(folder)
    return lines.select(parse_items().alias("item"), *(F.col(c).alias(n) for n, c in PLACE.items()))


def _reader(spark: SparkSession, glob: str, files_per_batch: int | None):
    reader = spark.readStream.option("pathGlobFilter", glob)
    return reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)


def read_positions(stream: DataFrame, item: str | Column, *positions: str) -> DataFrame:
    """Any stream as ``(item, *positions)``: for ``numbered``, with the columns that order it, such as topic, partition and offset."""
    value = F.col(item) if isinstance(item, str) else item
    return stream.select(value.cast("long").alias("item"), *positions)


def numbered(rows: DataFrame, table: str, checkpoint: str, n: int | None = None, trigger: dict = TO_THE_END,
             order: Sequence[str] = tuple(PLACE)) -> StreamingQuery:
    """Write a stream as ``(arrival, item)``, numbered from 0 in order of batches and, within one, of ``order``.

    ``order`` names columns that say where a row stands in its source; rows that agree in all of them,
    like the lines of one split of a file, keep the order in which they are read. A batch starts
    where the one before ended: each leaves one row with its end, so however long the stream
    runs, a batch looks at one earlier row. A batch that is repeated finds the same start and
    overwrites its rows and its end. With ``n`` nothing after the first ``n`` arrivals is written.
    """
    spark, ends = rows.sparkSession, f"{table}/{ENDS}"
    tables.prepare(spark, table, ARRIVALS)

    def write(batch: DataFrame, batch_id: int) -> None:
        # at most the two that are kept
        earlier = [k for k in tables.finished(spark, ends) if k < batch_id][-1:]
        start = tables.read(spark, ends, END, earlier).first()["end"] if earlier else 0
        made = spark.createDataFrame([], ARRIVALS)
        if n is None or start < n:
            made = number_arrivals(batch.withColumn("line", F.monotonically_increasing_id()), "item", [*order, "line"], start)
            made = made if n is None else made.filter(F.col("arrival") < n)
        made.write.mode("overwrite").parquet(tables.partition(table, batch_id))
        written = tables.read(spark, table, ARRIVALS, [batch_id]).count()  # from the footers
        spark.createDataFrame([(start + written,)], END).coalesce(1).write.mode("overwrite").parquet(tables.partition(ends, batch_id))
        tables.drop(spark, ends, [k for k in tables.finished(spark, ends) if k < batch_id - 1])
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(write).start()


def arrived(spark: SparkSession, table: str) -> int:
    """How many rows ``numbered`` has numbered so far, from its last end."""
    ends = f"{table}/{ENDS}"
    last = tables.finished(spark, ends)[-1:]
    return tables.read(spark, ends, END, last).first()["end"] if last else 0


def append(stream: DataFrame, table: str, checkpoint: str, trigger: dict = TO_THE_END) -> StreamingQuery:
    """Write a stateless stream as it comes."""
    return (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .trigger(**trigger).start(table))


def read_appended(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema(ARRIVALS).parquet(table)


def read_numbered(spark: SparkSession, table: str) -> DataFrame:
    return tables.read(spark, table, ARRIVALS)


def until(query: StreamingQuery, arrived: Callable[[], int], n: int, every: float = 0.2) -> None:
    """Stop a running query once ``arrived()`` is at least ``n``, or return when it ends by itself."""
    while not query.awaitTermination(every):
        if arrived() >= n:
            query.processAllAvailable()
            query.stop()


def updates(stream: DataFrame, table: str, checkpoint: str, latest: Callable[[DataFrame], DataFrame],
            trigger: dict = TO_THE_END, compacted: int = COMPACTED) -> StreamingQuery:
    """Write the rows of an aggregate that a micro-batch changed.

    ``latest`` reduces rows of many batches to the current ones. Every ``compacted``
    batches it is written for all batches before, as partition ``-2 - k``, which replaces them.
    """
    spark, schema = stream.sparkSession, stream.schema
    tables.prepare(spark, table, schema)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % compacted == 0:
            there, made = tables.finished(spark, table), -2 - batch_id
            if made not in there:
                old = [k for k in there if k < batch_id]
                latest(tables.read(spark, table, fields, old)).write.mode("overwrite").parquet(tables.partition(table, made))
            tables.drop(spark, table, [k for k in there if k < batch_id and k != made])
        batch.write.mode("overwrite").parquet(tables.partition(table, batch_id))
    return (stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(**trigger).foreachBatch(write).start())


def _latest_counts(rows: DataFrame) -> DataFrame:
    """Counts only grow, so the latest count of an item is its largest."""
    return rows.groupBy("item").agg(F.max("n").alias("n"))


def _latest_slots(rows: DataFrame) -> DataFrame:
    return rows.groupBy("slot").agg(F.max_by("item", "arrival").alias("item"), F.max("arrival").alias("arrival"))


def stream_histogram(stream: DataFrame, f: Frequency, table: str, checkpoint: str, **options) -> StreamingQuery:
    return updates(histogram(stream, f), table, checkpoint, _latest_counts, **options)


def read_histogram(spark: SparkSession, table: str) -> DataFrame:
    return _latest_counts(tables.read(spark, table, HISTOGRAM))


def stream_reservoir(stream: DataFrame, f: Frequency, table: str, checkpoint: str, **options) -> StreamingQuery:
    return updates(reservoir(stream, f), table, checkpoint, _latest_slots, **options)


def read_reservoir(spark: SparkSession, table: str) -> DataFrame:
    return _latest_slots(tables.read(spark, table, RESERVOIR))


def stream_sticky(stream: DataFrame, f: Frequency, table: str, checkpoint: str, **options) -> StreamingQuery:
    """Sticky sampling with one number of keyed state for each tracked item.

    A batch writes the items it counted, not the table. Within a batch rows may come in any
    order and partition; across batches arrivals must be in order, and one that goes back stops the query.
    """
    return updates(keyed.sticky_updates(stream, f), table, checkpoint, _latest_counts, **options)


def read_sticky(spark: SparkSession, table: str) -> DataFrame:
    return _latest_counts(tables.read(spark, table, STICKY))


def _latest_summaries(rows: DataFrame) -> DataFrame:
    """Counts and the arrivals of slots only grow."""
    return (rows.groupBy("kind", "key").agg(F.max(F.when(F.col("kind") == keyed.ITEM, F.col("a"))).alias("n"),
                                            F.max_by("a", "b").alias("last"), F.max("b").alias("b"))
            .select("kind", "key", F.coalesce("n", "last").alias("a"), "b"))


def stream_summaries(stream: DataFrame, f: Frequency, table: str, checkpoint: str, **options) -> StreamingQuery:
    """Histogram, reservoir and sticky table kept by one query that reads its source once."""
    return updates(keyed.summary_updates(stream, f), table, checkpoint, _latest_summaries, **options)


def read_summaries(spark: SparkSession, table: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(item, n)``, ``(slot, item, arrival)`` and ``(item, n)`` of the three structures."""
    rows = _latest_summaries(tables.read(spark, table, SUMMARIES))
    items_, slots = rows.filter(F.col("kind") == keyed.ITEM), rows.filter(F.col("kind") == keyed.SLOT)
    return (items_.select(F.col("key").alias("item"), F.col("a").alias("n")),
            slots.select(F.col("key").alias("slot"), F.col("a").alias("item"), F.col("b").alias("arrival")),
            items_.filter(F.col("b") != keyed.UNTRACKED).select(F.col("key").alias("item"), F.col("b").alias("n")))
