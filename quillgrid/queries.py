"""The registered queries: every operator over the given tables, whole."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators import grid, hitters, kcenter, outliers, words
from quillgrid.plans.lineage import cut, fresh_path
from quillgrid.sources import documents as docs
from quillgrid.sources import items as arrivals
from quillgrid.sources.placement import spread, widen
from quillgrid.sources.points import parse_points, points
from quillgrid.streaming import items as streams
from quillgrid.streaming import tables as stream_tables

SALTS = 8
EMBEDDING = dict(distance=0.05, neighbours=5)    # E: 500 points within +-0.4
ORDER = dict(distance=3.0, neighbours=3)         # O: 500 x 110 units
LINE_DISTANCE, LINE_NEIGHBOURS = 0.5, 3          # L: 50 x 100 units
TOP = 10
PARTS, K, K_ORDERS, SEED = 4, 5, 6, 7
SPLIT_WIDTH = 4096
RADIUS_NEIGHBOURS, RADIUS_NEIGHBOURS_ORDERS = 250, 5500
PHI, EPSILON, DELTA = 0.008, 0.002, 0.1


# -- inputs ---------------------------------------------------------------------

def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf) -> DataFrame:
    return widen(docs.documents(table(spark, sf, "documents")), "doc_id")


def lines(spark, sf) -> DataFrame:
    return docs.document_lines(documents(spark, sf))


def embedding_points(spark, sf) -> DataFrame:
    vector = F.col("embedding")
    return points(table(spark, sf, "embeddings"), vector[0], vector[1], "vec_id")


def embedding_texts(spark, sf) -> DataFrame:
    """The same points as lines of text, with a field too many."""
    vector = F.col("embedding")
    text = F.concat_ws(",", vector[0].cast("double"), vector[1].cast("double"), "label")
    return parse_points(table(spark, sf, "embeddings").select("vec_id", text.alias("text")), id="vec_id")


def order_points(spark, sf) -> DataFrame:
    joined = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return points(joined, F.col("o_totalprice") / 1000, F.col("c_acctbal") / 100, "o_orderkey")


def kept_order_points(spark, sf) -> DataFrame:
    """For operators that read their points several times: the join is made once."""
    return cut(order_points(spark, sf))


def line_points(spark, sf) -> DataFrame:
    """No unique key, so for the cell operators only."""
    return points(table(spark, sf, "lineitem"), "l_quantity", F.col("l_extendedprice") / 1000)


def event_items(spark, sf) -> DataFrame:
    return arrivals.items(table(spark, sf, "events"), "user_id", "event_id")


def frequency(spark, sf) -> hitters.Frequency:
    """All events; their number comes from the parquet footers."""
    return hitters.Frequency(table(spark, sf, "events").count(), PHI, EPSILON, DELTA)


def half(spark, sf) -> int:
    return max(1, table(spark, sf, "events").count() // 2)


# -- queries over streams ---------------------------------------------------------

def _streamed(spark, sf, start, read) -> DataFrame:
    """Run a stream over the event file to its end and return the table it wrote."""
    source = streams.read_items(spark, sf, "user_id", "event_id", "events.parquet")
    to, checkpoint = fresh_path(spark, "table"), fresh_path(spark, "progress")
    start(source, to, checkpoint).awaitTermination()
    stream_tables.remove(spark, checkpoint)
    return read(spark, to)


def stream_text_items(spark, sf):
    """The events' items as lines of text files, in order, read as a stream and numbered anew."""
    lines, to, checkpoint = (fresh_path(spark, what) for what in ("lines", "table", "progress"))
    (table(spark, sf, "events").repartitionByRange(PARTS, "event_id").sortWithinPartitions("event_id")
     .select(F.col("user_id").cast("string")).write.text(lines))
    streams.numbered(streams.read_lines(spark, lines), to, checkpoint).awaitTermination()
    for folder in (lines, checkpoint):
        stream_tables.remove(spark, folder)
    return streams.read_numbered(spark, to)


def stream_items(spark, sf):
    return _streamed(spark, sf, streams.append, streams.read_appended)


def stream_prefix(spark, sf):
    n = half(spark, sf)
    return _streamed(spark, sf, lambda v, t, c: streams.append(hitters.first_arrivals(v, n), t, c),
                     streams.read_appended)


def _frequent_stream(start, read):
    def run(spark, sf):
        f = frequency(spark, sf)
        return _streamed(spark, sf, lambda v, t, c: start(v, f, t, c), read)
    return run


def _from_one_stream(summary):
    """Histogram, reservoir and sticky table kept by one stream, then summed up."""
    def run(spark, sf):
        f = frequency(spark, sf)
        found = _streamed(spark, sf, lambda v, t, c: streams.stream_summaries(v, f, t, c), streams.read_summaries)
        return summary(*found, f)
    return run


def _on_items(operator):
    return lambda spark, sf: operator(event_items(spark, sf), frequency(spark, sf))


# -- k-center ---------------------------------------------------------------------

def _nearest(spark, sf):
    p = embedding_points(spark, sf)
    return kcenter.nearest_center(p, kcenter.farthest_first(p, K))


def _radius(p: DataFrame, k: int, parts: int | None) -> DataFrame:
    return kcenter.covering_radius(p, kcenter.coreset_centers(p, k, parts))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    e, o, ln = embedding_points, kept_order_points, line_points
    return {
        # sources
        "doc_lines": lines,
        "count_docs": lambda s, sf: words.count_documents(table(s, sf, "documents")),
        "load_points": e,
        "parse_points": embedding_texts,
        "spread_points": lambda s, sf: spread(e(s, sf), PARTS, "id"),
        "count_points": lambda s, sf: grid.count_points(e(s, sf)),
        "stream_items": stream_items,
        "stream_text_items": stream_text_items,
        "item_positions": lambda s, sf: arrivals.number_arrivals(
            table(s, sf, "events"), "user_id", ["ts", "event_id"]),
        # word count
        "word_count_per_doc": lambda s, sf: words.per_document(lines(s, sf)),
        "word_count_per_doc_salted": lambda s, sf: words.per_document_salted(lines(s, sf), SALTS),
        "word_count": lambda s, sf: words.word_count(documents(s, sf)),
        "word_count_salted": lambda s, sf: words.salted(lines(s, sf), SALTS),
        "word_count_salted_fly": lambda s, sf: words.salted_on_the_fly(lines(s, sf), SALTS),
        "word_count_partition": lambda s, sf: words.by_partition(lines(s, sf)),
        "distinct_words": lambda s, sf: words.distinct_words(documents(s, sf)),
        "avg_word_length": lambda s, sf: words.average_word_length(documents(s, sf)),
        # grid and outliers
        "point_cells": lambda s, sf: grid.point_cells(e(s, sf), EMBEDDING["distance"]),
        "cell_histogram": lambda s, sf: grid.cell_histogram(ln(s, sf), LINE_DISTANCE),
        "cell_neighbourhoods": lambda s, sf: grid.cell_neighbourhoods(ln(s, sf), LINE_DISTANCE),
        "approx_outliers": lambda s, sf: grid.approximate_outliers(e(s, sf), **EMBEDDING),
        "approx_outliers_lines": lambda s, sf: grid.approximate_outliers(
            ln(s, sf), LINE_DISTANCE, LINE_NEIGHBOURS),
        "smallest_cells": lambda s, sf: grid.smallest_cells(ln(s, sf), LINE_DISTANCE, TOP),
        "neighbour_counts": lambda s, sf: outliers.neighbour_counts(e(s, sf), EMBEDDING["distance"]),
        "neighbour_counts_orders": lambda s, sf: outliers.neighbour_counts(o(s, sf), ORDER["distance"]),
        "exact_outlier_count": lambda s, sf: outliers.count_exact_outliers(e(s, sf), **EMBEDDING),
        "exact_outlier_count_orders": lambda s, sf: outliers.count_exact_outliers(o(s, sf), **ORDER),
        "top_outliers": lambda s, sf: outliers.top_outliers(e(s, sf), **EMBEDDING, rows=TOP),
        "top_outliers_orders": lambda s, sf: outliers.top_outliers(o(s, sf), **ORDER, rows=TOP),
        "outlier_report": lambda s, sf: outliers.outlier_report(e(s, sf), **EMBEDDING),
        "outlier_report_orders": lambda s, sf: outliers.outlier_report(o(s, sf), **ORDER),
        # k-center
        "kcenter_global": lambda s, sf: kcenter.global_centers(e(s, sf), K),
        "kcenter_global_seeded": lambda s, sf: kcenter.global_centers(e(s, sf), K, SEED),
        "kcenter_coreset": lambda s, sf: kcenter.coreset(kcenter.by_id(e(s, sf), PARTS), K),
        "kcenter_coreset_orders": lambda s, sf: kcenter.coreset(kcenter.by_id(o(s, sf), PARTS), K_ORDERS),
        "kcenter_coreset_split": lambda s, sf: kcenter.split_coresets(o(s, sf), K_ORDERS, SPLIT_WIDTH),
        "kcenter_mr": lambda s, sf: kcenter.mapreduce_centers(e(s, sf), K, PARTS),
        "kcenter_mr_orders": lambda s, sf: kcenter.mapreduce_centers(o(s, sf), K_ORDERS, PARTS),
        "kcenter_mr_split": lambda s, sf: kcenter.merged_coresets(
            kcenter.split_coresets(o(s, sf), K_ORDERS, SPLIT_WIDTH), K_ORDERS),
        "nearest_center": _nearest,
        "kcenter_radius": lambda s, sf: _radius(e(s, sf), K, PARTS),
        "kcenter_radius_orders": lambda s, sf: _radius(o(s, sf), K_ORDERS, PARTS),
        "kcenter_outliers": lambda s, sf: kcenter.radius_outliers(
            o(s, sf), K_ORDERS, RADIUS_NEIGHBOURS_ORDERS, PARTS),
        "kcenter_outliers_embeddings": lambda s, sf: kcenter.radius_outliers(
            e(s, sf), K, RADIUS_NEIGHBOURS, PARTS),
        # frequent items
        "stream_prefix": stream_prefix,
        "item_histogram": _on_items(hitters.histogram),
        "stream_histogram": _frequent_stream(streams.stream_histogram, streams.read_histogram),
        "frequent_exact": _on_items(hitters.frequent_exact),
        "reservoir_sample": _on_items(hitters.reservoir),
        "reservoir_sample_stream": _frequent_stream(streams.stream_reservoir, streams.read_reservoir),
        "frequent_reservoir": _on_items(hitters.frequent_reservoir),
        "sticky_counts": _on_items(hitters.sticky),
        "sticky_counts_stream": _frequent_stream(streams.stream_sticky, streams.read_sticky),
        "frequent_sticky": _on_items(hitters.frequent_sticky),
        "frequent_flags": _on_items(hitters.frequent_flags),
        "frequent_flags_stream": _from_one_stream(hitters.flags),
        "heavy_hitter_report": _on_items(hitters.report),
        "heavy_hitter_report_stream": _from_one_stream(hitters.sizes),
    }
