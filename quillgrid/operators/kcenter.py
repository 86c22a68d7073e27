"""k-center clustering by farthest-first traversal.

Ties go to the lowest id, and a traversal ends early once every point is a center.
A traversal reads its points once per center, with their distances to the centers before
the last few, and brings only that center to the driver.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import checks, rng
from quillgrid.functions.geometry import nearest_center_struct, nearest_squared, squared_distance
from quillgrid.operators.grid import approximate_outliers
from quillgrid.plans.centers import nearest_of_many
from quillgrid.plans.lineage import cut

CENTERS = pa.schema({"rank": pa.int32(), "id": pa.int64(), "x": pa.float64(), "y": pa.float64()})
CARRIED = 8                 # centers after which the distances to them are written down
COLLECTED_ROWS = 100_000    # centers of all groups that may come to the driver, one round at a time
BROADCAST_GROUPS = 100_000  # one row of at most CARRIED centers per group on every executor
SPLIT_WIDTH = 1_000_000     # points of one split in a Python worker, 40 bytes each
UNROLLED = 64               # centers of one expression
FAN = 16                    # coresets that are merged at once

Centers = list[tuple[int, float, float]]


def _plane(centers: Centers) -> list[tuple[float, float]]:
    if not centers:
        raise ValueError("no centers: the point set is empty")
    return [(x, y) for _, x, y in centers]


def farthest_first(points: DataFrame, k: int, seed: int | None = None) -> Centers:
    """At most ``k`` centers ``(id, x, y)`` in the order chosen.

    The start is the lowest id or, with a seed, the id with the lowest draw.
    """
    checks.whole("k", k, 1)
    start = F.col("id") if seed is None else F.struct(rng.uniform(F.col("id"), f"{seed}:"), "id")
    left = points.select("id", "x", "y")
    first = left.agg(F.min_by(F.struct("id", "x", "y"), start).alias("c")).first().c
    chosen = [] if first is None else [tuple(first)]
    left, new = left.withColumn("d2", F.lit(float("inf"))), list(chosen)
    while chosen and len(chosen) < k:
        scored = left.withColumn("d2", F.least("d2", nearest_squared(F.col("x"), F.col("y"), _plane(new))))
        if len(new) == CARRIED:
            left, new = cut(scored), []
            scored = left
        far = scored.agg(F.max_by(F.struct("id", "x", "y", "d2"), F.struct("d2", -F.col("id"))).alias("c")).first().c
        if far.d2 == 0:
            break
        chosen.append((far.id, far.x, far.y))
        new.append(chosen[-1])
    return chosen


def _table(points: DataFrame, centers: Centers) -> DataFrame:
    ids, xs, ys = zip(*centers) if centers else ((), (), ())
    columns = (range(len(ids)), ids, xs, ys)
    return points.sparkSession.createDataFrame(
        pa.table([pa.array(c, f.type) for c, f in zip(columns, CENTERS)], schema=CENTERS))


def global_centers(points: DataFrame, k: int, seed: int | None = None) -> DataFrame:
    """Farthest-first over all points: ``(rank, id, x, y)``. Within twice the optimum."""
    return _table(points, farthest_first(points, k, seed))


def _farthest(scored: DataFrame) -> DataFrame:
    """``(g, id, x, y)``: the farthest point of each group that has one, the lowest id on ties.

    Each batch of rows gives one row per group before anything is shuffled.
    """
    def best(batches):
        for batch in batches:
            rows = batch.to_pandas()
            rows = rows[rows["d2"] > 0].sort_values(["d2", "id"], ascending=[False, True])
            yield pa.RecordBatch.from_pandas(rows.drop_duplicates("g"), batch.schema, preserve_index=False)
    one = F.max_by(F.struct("id", "x", "y"), F.struct("d2", -F.col("id"))).alias("c")
    return scored.mapInArrow(best, scored.schema).groupBy("g").agg(one).select("g", "c.*")


def coreset(points: DataFrame, k: int) -> DataFrame:
    """Farthest-first inside each group ``g`` at once: ``(g, rank, id, x, y)``.

    Round by round, the groups' next centers are found in one pass over the points and
    joined to them, one row per group. Points keep their distance to the centers so far,
    so a round costs the same however many there are. No group is gathered anywhere.
    """
    checks.whole("k", k, 1)
    left = points.select("g", "id", "x", "y")
    lowest = left.groupBy("g").agg(F.min("id").alias("id"))
    groups = lowest.count()

    def settle(rows: DataFrame) -> tuple[DataFrame, bool]:
        if groups * k > COLLECTED_ROWS:
            rows = cut(rows)
            return rows, not rows.isEmpty()
        here = rows.toArrow()
        return points.sparkSession.createDataFrame(here, rows.schema), len(here) > 0

    def small(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if groups <= BROADCAST_GROUPS else rows

    newest, more = settle(left.join(small(lowest), ["g", "id"]).select("g", "id", "x", "y"))
    rounds, new = [newest], [newest]
    left = left.withColumn("d2", F.lit(float("inf")))
    while more and len(rounds) < k:
        # a group that ran out of points has fewer new centers, and least leaves the missing ones out
        flat = None
        for i, centers in enumerate(new):
            one = centers.select("g", F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"))
            flat = one if flat is None else flat.join(small(one), "g", "left")
        d2 = [squared_distance(F.col("x"), F.col("y"), F.col(f"x{i}"), F.col(f"y{i}")) for i in range(len(new))]
        scored = left.join(small(flat), "g").select("g", "id", "x", "y", F.least("d2", *d2).alias("d2"))
        if len(new) == CARRIED:
            left, new = cut(scored), []
            scored = left
        newest, more = settle(_farthest(scored))
        if more:
            rounds.append(newest)
            new.append(newest)
    out = None
    for rank, centers in enumerate(rounds):
        row = centers.select("g", F.lit(rank).alias("rank"), "id", "x", "y")
        out = row if out is None else out.unionByName(row)
    return out


COVER = "node long, rank int, id long, x double, y double, n long, radius double"


def _covers(points: DataFrame, k: int) -> DataFrame:
    """Farthest-first inside each ``node`` of ``(node, id, x, y, n, radius)``, with what each center stands for.

    A row goes to its nearest center, the lowest rank on ties. A center stands for the ``n`` of its rows,
    and none of what they stand for is farther from it than ``radius``.
    """
    def covered(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x, y, n, radius = (table.column(c).to_numpy() for c in ("x", "y", "n", "radius"))
        rows, d2, mine, at = [], np.full(len(x), np.inf), np.zeros(len(x), np.int64), 0
        while len(rows) < k and d2[at] > 0:
            new = (x - x[at]) * (x - x[at]) + (y - y[at]) * (y - y[at])
            mine[new < d2] = len(rows)
            rows.append(at)
            np.minimum(d2, new, out=d2)
            at = int(d2.argmax())
        reach, stands = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
        np.maximum.at(reach, mine, np.sqrt(d2) + radius)
        np.add.at(stands, mine, n)
        centers = table.take(rows)
        return pa.table({"node": centers.column("node"), "rank": pa.array(range(len(rows)), pa.int32()), "id": centers.column("id"),
                         "x": centers.column("x"), "y": centers.column("y"), "n": stands, "radius": reach})
    return points.select("node", "id", "x", "y", "n", "radius").groupBy("node").applyInArrow(covered, COVER)


def split_coresets(points: DataFrame, k: int, width: int = SPLIT_WIDTH) -> DataFrame:
    """A coreset of each split: ``(node, rank, id, x, y, n, radius)``, ``k`` centers for ``width`` consecutive ids.

    As ids are unique, a split has at most ``width`` points, in one task. Splits follow from the ids
    alone, whatever the partitions, and are counted from the lowest one.
    """
    checks.whole("k", k, 1)
    checks.whole("width", width, 1)
    low = points.agg(F.min("id").alias("low")).first().low or 0
    from_low = F.col("id") - F.lit(low)
    return _covers(points.select(((from_low - F.pmod(from_low, F.lit(width))) / width).cast("long").alias("node"), "id", "x", "y",
                                 F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("radius")), k)


def merged_coresets(coresets: DataFrame, k: int, fan: int = FAN) -> DataFrame:
    """One cover of the whole, in the form of ``split_coresets``, from the coresets of its splits.

    ``fan`` neighbouring nodes become one, again and again, and ``k`` centers of their centers stay. Radii
    add up on the way, so every point is within ``radius`` of the center that stands for it, which
    the points can prove or disprove. No task sees more than ``fan * k`` rows.
    """
    checks.whole("k", k, 1)
    checks.whole("fan", fan, 2)
    coresets = cut(coresets)    # K rows for each split: the points are read once
    last = coresets.agg(F.max("node").alias("last")).first().last or 0
    while last > 0:
        up = F.col("node")
        coresets = _covers(coresets.withColumn("node", ((up - F.pmod(up, F.lit(fan))) / fan).cast("long")), k)
        last //= fan
    return coresets


def coreset_centers(points: DataFrame, k: int, parts: int | None = None) -> Centers:
    """Centers of the whole from the centers of its parts.

    ``parts`` divides the points by id, reproducibly, and gives centers within four times the optimum;
    without it they come from a tree of splits, see ``merged_coresets``.
    """
    if parts is None:
        found = merged_coresets(split_coresets(points, k), k)
        return [(r.id, r.x, r.y) for r in found.orderBy("rank").select("id", "x", "y").collect()]    # at most k
    return farthest_first(coreset(by_id(points, parts), k), k)


def by_id(points: DataFrame, parts: int) -> DataFrame:
    """Divide the points into groups ``g`` by id."""
    return points.withColumn("g", F.pmod("id", F.lit(checks.whole("parts", parts, 1))))


def mapreduce_centers(points: DataFrame, k: int, parts: int | None = None) -> DataFrame:
    return _table(points, coreset_centers(points, k, parts))


def nearest_center(points: DataFrame, centers: Centers) -> DataFrame:
    """``(id, center, d2)``: rank of the closest center (lowest on ties) and its distance.

    Some centers become one expression, many a grid that each point searches around itself.
    """
    if len(centers) > UNROLLED:
        return nearest_of_many(points, _plane(centers))
    best = nearest_center_struct(F.col("x"), F.col("y"), _plane(centers))
    return points.select("id", best.alias("best")).select(
        "id", F.col("best.center").alias("center"), F.col("best.d2").alias("d2"))


def covering_radius(points: DataFrame, centers: Centers) -> DataFrame:
    """The largest distance from a point to its closest center."""
    if len(centers) > UNROLLED:
        return nearest_of_many(points, _plane(centers)).agg(F.sqrt(F.max("d2")).alias("radius"))
    d2 = nearest_squared(F.col("x"), F.col("y"), _plane(centers))
    return points.agg(F.sqrt(F.max(d2)).alias("radius"))


def radius_outliers(points: DataFrame, k: int, neighbours: int, parts: int | None = None) -> DataFrame:
    """Grid bounds on the outliers within the covering radius of ``k`` centers."""
    radius = covering_radius(points, coreset_centers(points, k, parts)).first().radius
    return (approximate_outliers(points, radius, neighbours)
            .select(F.lit(radius).alias("radius"), "sure", "uncertain"))
