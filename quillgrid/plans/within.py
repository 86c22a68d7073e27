"""How many data points lie within a distance of each query point.

Points are binned into cells twice as wide as the distance, and pairs of adjacent cells
are settled from the extents of their points: wholly in reach (the count of the cell is
added), wholly out of reach (dropped), or open. An open pair with few point pairs is
compared point by point. In an open pair of larger cells that a task can hold, the points of one are swept over
strips of the other. An open pair of still larger ones is split, both cells into 4x4, and its
parts are settled in the same way. Copies of one point have no extent and are always
settled whole. So a cell that holds a third of all points never meets itself or a
neighbour point by point, and every join key has a bounded number of rows.

A point goes to few keys: splitting cells until pairs of their points are few would send each point to as many
keys as there are small cells on the rim of its reach, and their number grows with the points in reach.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.functions import checks
from quillgrid.functions.geometry import (
    EXTENT, box, cell_index, extent, farthest_between, nearest_between, point_box, squared_distance)
from quillgrid.plans.hot import BROADCAST_ROWS, hot_bound, hot_cells, lookup, outside_hot
from quillgrid.plans.lineage import cut

WIDTH = 2             # of a cell, in distances: a disc then meets 3.8 cells, not 8.1
LEAF_PAIRS = 1 << 16  # point pairs of two cells that are compared one by one; below HOT_FLOOR
LEAF_POINTS = 1 << 18  # points of either cell that are swept in one task; below HOT_FLOOR
FACING_POINTS = 1 << 20  # points of facing cells that a cell meets at once
TASK_POINTS = 1 << 21  # points dealt to one task for that
STRIP = 4             # a strip has so many times the root of all points, which levels the strips and the points of a sweep
SPLIT_BITS = 2        # 4x4 parts per split
DEEPEST = 26          # splits; the smallest parts are then the spacing of doubles
TASK_TESTS = 1 << 27  # point pairs compared by one task
BROADCAST_POINTS = 1 << 21  # of 16 bytes each that are sent to all tasks
SWEPT = 1 << 18       # points of strips tested at once
MATRIX, SMALL = 1 << 15, 1 << 12  # point pairs compared at once, to fit a cache; small pairs of cells share that
MOST_TASKS = 100_000
SCAN_TESTS = 100      # comparisons per point that a scan may take on


def _locate(points: DataFrame, side: float) -> DataFrame:
    return points.select("id", "x", "y", cell_index(F.col("x"), side).alias("i"),
                         cell_index(F.col("y"), side).alias("j"))


def _cells(located: DataFrame) -> DataFrame:
    return cut(located.groupBy("i", "j").agg(F.count("*").alias("n"), *extent()))


def _named(cells: DataFrame, prefix: str) -> DataFrame:
    return cells.select([F.col(c).alias(prefix + c) for c in cells.columns])


def _settle(pairs: DataFrame, limit: float) -> DataFrame:
    """Drop the cell pairs out of reach and mark those wholly in reach."""
    a, b = box("a_"), box("b_")
    return (pairs.filter(nearest_between(a, b) <= F.lit(limit))
            .withColumn("whole", farthest_between(a, b) <= F.lit(limit))
            .withColumn("work", F.col("a_n").cast("double") * F.col("b_n"))
            .select("a_i", "a_j", "a_n", "b_i", "b_j", "b_n", "whole", "work", *_box_names("a_"), *_box_names("b_")))


def _box_names(prefix: str) -> list[str]:
    return [prefix + c for c in EXTENT]


def _adjacent(a: DataFrame, b: DataFrame) -> DataFrame:
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    reached = (_named(a, "a_").withColumn("di", step).withColumn("dj", step)
               .withColumn("b_i", F.col("a_i") + F.col("di"))
               .withColumn("b_j", F.col("a_j") + F.col("dj")).drop("di", "dj"))
    return reached.join(_named(b, "b_"), ["b_i", "b_j"])


def _parts(open_pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of parts of the two cells of each open pair."""
    def parts(cells, prefix):
        return _named(cells, prefix).withColumns({
            f"{prefix}up_i": F.shiftright(f"{prefix}i", SPLIT_BITS),
            f"{prefix}up_j": F.shiftright(f"{prefix}j", SPLIT_BITS)})
    up = open_pairs.select(*(F.col(c).alias(c.replace("_", "_up_")) for c in ("a_i", "a_j", "b_i", "b_j")))
    return (up.join(parts(a, "a_"), ["a_up_i", "a_up_j"])
            .join(parts(b, "b_"), ["b_up_i", "b_up_j"]))


def _added(queries, data, pairs, leaf, rows, tests, limit, a_size, b_size, hot_a, hot_b, every) -> DataFrame:
    """Rows ``(id, x, y, n)`` to be summed: one level's settled and leaf pairs.

    The place of a point is given once or more, and is NULL in the rows of its pairs.
    """
    base = (pairs.filter("whole").groupBy("a_i", "a_j").agg(F.sum("b_n").alias("n"))
            .select(F.col("a_i").alias("i"), F.col("a_j").alias("j"), "n"))
    whole = lookup(queries, base, a_size.cells, hot_a, "left" if every else "inner")
    whole = whole.select("id", "x", "y", F.coalesce("n", F.lit(0)).alias("n"))

    if rows == 0:
        return whole
    # a cell of a leaf has at most LEAF_POINTS points, so none of them is hot, and once the points of all
    # other cells are out of the way no key has more; until then large ones are left to adaptive splitting
    def of_leaves(points, which, side_of, size):
        names = pairs.filter(which).select(F.col(f"{side_of}_i").alias("i"), F.col(f"{side_of}_j").alias("j")).distinct()
        return points.join(F.broadcast(names) if size.cells <= BROADCAST_ROWS else names, ["i", "j"], "left_semi")
    def of_both(which):
        return (of_leaves(outside_hot(queries, hot_a), which, "a", a_size), of_leaves(outside_hot(data, hot_b), which, "b", b_size))
    nowhere = F.lit(None).cast("double")
    spark = queries.sparkSession
    if rows <= BROADCAST_ROWS and tests <= SCAN_TESTS * b_size.points:
        mine, other = of_both(leaf)
        facing = (mine.join(pairs.filter(leaf).withColumnsRenamed({"a_i": "i", "a_j": "j"}), ["i", "j"])
                  .filter(nearest_between(point_box(F.col("x"), F.col("y")), box("b_")) <= F.lit(limit))
                  .select("id", "x", "y", F.col("b_i").alias("i"), F.col("b_j").alias("j")))
        other = other.select("i", "j", F.col("x").alias("b_x"), F.col("y").alias("b_y"))
        d2 = squared_distance(F.col("x"), F.col("y"), F.col("b_x"), F.col("b_y"))
        close = other.join(F.broadcast(facing), ["i", "j"]).filter(d2 <= F.lit(limit)).select("id", F.lit(1).cast("long").alias("n"))
    else:
        small, large = leaf & (F.col("work") <= LEAF_PAIRS), leaf & (F.col("work") > LEAF_PAIRS)
        tests, facing = pairs.agg(F.sum(F.when(small, F.col("work"))), F.sum(F.when(large, F.col("b_n")))).first()
        found = []
        if tests:
            # by the comparisons to make: the bytes, which size shuffles otherwise, say little
            tasks = max(_tasks(spark), min(MOST_TASKS, int(tests / TASK_TESTS)))
            leaves = pairs.filter(small).withColumnsRenamed({"a_i": "i", "a_j": "j"})
            found.append(_compared(leaves, *of_both(small), tasks, limit))
        if facing:
            tasks = max(_tasks(spark), min(MOST_TASKS, int(facing / TASK_POINTS)))
            found.append(_swept(pairs.filter(large), outside_hot(queries, hot_a), outside_hot(data, hot_b), tasks, limit))
        close = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return whole.unionByName(close.select("id", nowhere.alias("x"), nowhere.alias("y"), "n"))


def _packed(points: DataFrame, side: str, *columns: str) -> DataFrame:
    """One row for each leaf cell with all of its points, at most ``LEAF_PAIRS``."""
    return points.groupBy(F.col("i").alias(f"{side}_i"), F.col("j").alias(f"{side}_j")).agg(
        F.collect_list(F.struct(*columns)).alias(side))


def _compared(leaves: DataFrame, queries: DataFrame, data: DataFrame, tasks: int, limit: float) -> DataFrame:
    """``id, n``: query points and how many points of facing cells each of them reaches.

    The points of a cell are one array, so a pair of points is never a row; they are compared in numpy, in the
    arithmetic of ``squared_distance``. Few data points are sent to all tasks, after being counted, and a
    cell meets all cells that it faces at once; beyond ``BROADCAST_POINTS`` two facing cells meet in one row.
    """
    faced = leaves.select(F.col("i").alias("a_i"), F.col("j").alias("a_j"), "b_i", "b_j")
    mine = _packed(queries, "a", "id", "x", "y")
    if data.count() <= BROADCAST_POINTS:
        cells = data.sparkSession.sparkContext.broadcast(_CellPoints.of(data.select("i", "j", "x", "y").toArrow()))
        lists = faced.groupBy("a_i", "a_j").agg(F.collect_list(F.struct("b_i", "b_j")).alias("b"))
        met = mine.join(lists, ["a_i", "a_j"]).repartition(tasks, "a_i", "a_j").select("a", "b")
        facing = lambda b: cells.value.of_cells(b.field("b_i").to_pylist(), b.field("b_j").to_pylist())
    else:
        met = (faced.join(mine, ["a_i", "a_j"]).repartition(tasks, "b_i", "b_j")
               .join(_packed(data, "b", "x", "y").repartition(tasks, "b_i", "b_j"), ["b_i", "b_j"]).select("a", "b"))
        facing = None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            a_at, b_at = (c.offsets.to_numpy() - c.offsets[0].as_py() for c in (a, b))
            a, b = a.flatten(), b.flatten()
            ids, x, y = (a.field(c).to_numpy() for c in ("id", "x", "y"))
            if facing is None:
                n = _close_pairs(x, y, a_at, b.field("x").to_numpy(), b.field("y").to_numpy(), b_at, limit)
            else:
                data_x, data_y, starts, sizes = facing(b)
                n = np.zeros(len(x), np.int64)
                for row in range(batch.num_rows):
                    low, high = a_at[row], a_at[row + 1]
                    at = ranges(starts[b_at[row]:b_at[row + 1]], sizes[b_at[row]:b_at[row + 1]])
                    n[low:high] = _in_reach(x[low:high], y[low:high], data_x[at], data_y[at], limit)
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some])], names=["id", "n"])
    return met.mapInArrow(counted, "id long, n long")


def _swept(leaves: DataFrame, queries: DataFrame, data: DataFrame, tasks: int, limit: float) -> DataFrame:
    """``id, n`` as of ``_compared``, for pairs of cells of up to ``LEAF_POINTS`` points each.

    A cell and about ``FACING_POINTS`` points of those it faces are a group; of these only points in reach of the
    extent of the cell are sent, and all that comes back is a row for each point of the cell.
    """
    so_far = W.partitionBy("a_i", "a_j").orderBy("b_i", "b_j").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("b_n").over(so_far), F.lit(0))
    parts = leaves.withColumn("part", F.floor(before / F.lit(FACING_POINTS)))
    groups = cut(parts.groupBy("a_i", "a_j", "part").agg(
        F.collect_list(F.struct("b_i", "b_j")).alias("b"), *(F.first(c).alias(c) for c in _box_names("a_")))
        .withColumn("group", F.monotonically_increasing_id()))
    cells = groups.select("group", F.explode("b").alias("b"), *_box_names("a_")).select("group", "b.b_i", "b.b_j", *_box_names("a_"))
    few = leaves.count() <= BROADCAST_ROWS
    def met(points, side, names):
        named = points.withColumnsRenamed({"i": f"{side}_i", "j": f"{side}_j"})
        return named.join(F.broadcast(names) if few else names, [f"{side}_i", f"{side}_j"])
    mine = met(queries, "a", groups.select("group", "a_i", "a_j")).select("group", "id", "x", "y")
    near = (met(data, "b", cells).filter(nearest_between(point_box(F.col("x"), F.col("y")), box("a_")) <= F.lit(limit))
            .select(F.col("group").alias("of"), F.col("x").alias("b_x"), F.col("y").alias("b_y")))

    def counted(a: pa.Table, b: pa.Table) -> pa.Table:
        ax, ay, bx, by = (t.column(c).to_numpy() for t, c in ((a, "x"), (a, "y"), (b, "b_x"), (b, "b_y")))
        n = _sweep(ax, ay, bx, by, limit)
        some = n > 0
        return pa.table({"id": pa.array(a.column("id").to_numpy()[some], pa.int64()), "n": pa.array(n[some], pa.int64())})
    return (mine.repartition(tasks, "group").groupBy("group")
            .cogroup(near.repartition(tasks, "of").groupBy("of")).applyInArrow(counted, "id long, n long"))


def _places(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different points, ascending, the number of copies of each, and which of them every point is."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    return x[new], y[new], np.bincount(which), which


def _sweep(ax, ay, bx, by, limit: float) -> np.ndarray:
    """For each point of ``a`` the points of ``b`` in reach.

    Strips of ``b`` have as many points each, whatever their height, in order of x. A run of them is in reach for
    certain, by the extent of the strip; those beside the run that could be are tested one by one, in the arithmetic of
    ``squared_distance``. The run is a little smaller, and what is tested a little more, than any rounding could ask for.
    """
    if not len(ax) or not len(bx):
        return np.zeros(len(ax), np.int64)
    ax, ay, _, which = _places(ax, ay)
    bx, by, copies, _ = _places(bx, by)
    out = np.zeros(len(ax), np.int64)
    slack = max(limit * 1e-14, 1e-300)
    by_y = by.argsort(kind="stable")
    size = max(1, int(STRIP * math.sqrt(len(bx))))
    for at in range(0, len(bx), size):
        strip = np.sort(by_y[at:at + size])         # points are in order of x
        low, high = by[by_y[at]], by[by_y[min(at + size, len(bx)) - 1]]
        x, y, many = bx[strip], by[strip], copies[strip]
        gap, far = np.maximum(np.maximum(low - ay, ay - high), 0.0), np.maximum(high - ay, ay - low)
        outer = limit + slack - gap * gap
        reached = np.flatnonzero(outer >= 0)
        if not len(reached):
            continue
        mine, wide, inner = ax[reached], np.sqrt(outer[reached]), limit - slack - far[reached] ** 2
        narrow = np.sqrt(np.maximum(inner, 0.0))
        pad = 1e-15 * (np.abs(mine) + wide)
        first, end = x.searchsorted(mine - wide - pad, "left"), x.searchsorted(mine + wide + pad, "right")
        sure, sure_end = x.searchsorted(mine - narrow + pad, "left"), x.searchsorted(mine + narrow - pad, "right")
        none = (inner < 0) | (sure >= sure_end)
        sure[none] = sure_end[none] = end[none]
        total = np.append(0, np.cumsum(many))
        out[reached] += total[sure_end] - total[sure]
        starts, sizes = np.concatenate([first, sure_end]), np.concatenate([sure - first, end - sure_end])
        whose = np.concatenate([reached, reached])
        some = np.flatnonzero(sizes > 0)
        for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(sizes[some]) // SWEPT)) + 1):
            i, j = np.repeat(whose[part], sizes[part]), ranges(starts[part], sizes[part])
            dx, dy = ax[i] - x[j], ay[i] - y[j]
            close = dx * dx + dy * dy <= limit
            out += np.bincount(i[close], many[j[close]], len(out)).astype(np.int64)
    return out[which]


class _CellPoints:
    """Points cell by cell."""

    def __init__(self, x: np.ndarray, y: np.ndarray, starts: np.ndarray, places: dict[tuple[int, int], int]):
        self.x, self.y, self.starts, self.places = x, y, starts, places

    @classmethod
    def of(cls, points: pa.Table) -> "_CellPoints":
        i, j, x, y = (points.column(c).to_numpy() for c in ("i", "j", "x", "y"))
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])) if len(i) else np.empty(0, bool))
        places = {cell: k for k, cell in enumerate(zip(i[first].tolist(), j[first].tolist()))}
        return cls(x[order], y[order], np.append(first, len(i)), places)

    def of_cells(self, i: list[int], j: list[int]) -> tuple[np.ndarray, ...]:
        """All points, and where those of each cell start and how many they are."""
        place = np.fromiter(map(self.places.__getitem__, zip(i, j)), np.int64, len(i))
        return self.x, self.y, self.starts[place], self.starts[place + 1] - self.starts[place]


def _in_reach(ax, ay, bx, by, limit: float) -> np.ndarray:
    """For each point of ``a`` the points of ``b`` in reach."""
    step = max(1, MATRIX // max(1, len(bx)))
    out = np.empty(len(ax), np.int64)
    for low in range(0, len(ax), step):
        dx, dy = ax[low:low + step, None] - bx, ay[low:low + step, None] - by
        dx *= dx
        dy *= dy
        dx += dy
        out[low:low + step] = np.count_nonzero(dx <= limit, axis=1)
    return out


def _close_pairs(ax, ay, a_at, bx, by, b_at, limit: float) -> np.ndarray:
    """For each point of ``a`` the points in reach in the run of ``b`` that faces its own run."""
    out = np.zeros(len(ax), np.int64)
    a_size, b_size = np.diff(a_at), np.diff(b_at)
    work = a_size * b_size
    # small runs all at once, some MATRIX pairs at a time
    small = np.flatnonzero(work <= SMALL)
    for part in np.split(small, np.flatnonzero(np.diff(np.cumsum(work[small]) // MATRIX)) + 1):
        mine = ranges(a_at[part], a_size[part])
        facing = np.repeat(b_size[part], a_size[part])
        i = np.repeat(mine, facing)
        j = ranges(np.repeat(b_at[part], a_size[part]), facing)
        dx, dy = ax[i] - bx[j], ay[i] - by[j]
        out += np.bincount(i[dx * dx + dy * dy <= limit], minlength=len(out))
    for run in np.flatnonzero(work > SMALL):
        low, high = a_at[run], a_at[run + 1]
        out[low:high] = _in_reach(ax[low:high], ay[low:high], bx[b_at[run]:b_at[run + 1]], by[b_at[run]:b_at[run + 1]], limit)
    return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size says."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class _Size:
    """What a level has to know about its cells before the next plan is chosen."""

    def __init__(self, cells: DataFrame):
        far = F.greatest(*(F.abs(c) for c in ("x_lo", "x_hi", "y_lo", "y_hi")))
        row = cells.agg(F.count("*"), F.sum("n"), F.max("n"), F.max(far)).first()
        self.cells, self.points, self.largest, self.reach = (v or 0 for v in row)
        self.hot = hot_cells(cells, self.points, self.largest)


def count_within(queries: DataFrame, data: DataFrame, distance: float) -> DataFrame:
    """``(id, x, y, n)``: data points at most ``distance`` away from each query point.

    Both frames are ``(id, x, y)`` with unique ids; pass the same frame twice to count
    the neighbours, each point included. The work of a level is sized by small jobs
    while the plan is built.
    """
    checks.positive("distance", distance)
    limit, side, same = distance * distance, distance * WIDTH, queries is data
    a_points = _locate(queries, side)
    b_points = a_points if same else _locate(data, side)
    b_cells = _cells(b_points)
    a_cells = b_cells if same else _cells(a_points)
    b_size = _Size(b_cells)
    a_size = b_size if same else _Size(a_cells)
    bits = math.log2(max(b_size.reach, a_size.reach, side) / side)  # at most 52, see cell_index
    deepest = min(DEEPEST, int((52 - bits) // SPLIT_BITS))

    sums, level = [], 0
    pairs = cut(_settle(_adjacent(a_cells, b_cells), limit))
    while True:
        is_open = ~F.col("whole")
        held = F.greatest("a_n", "b_n") <= min(LEAF_POINTS, hot_bound(0))
        leaf = is_open if level == deepest else is_open & ((F.col("work") <= LEAF_PAIRS) | held)
        heavy = pairs.filter(is_open & ~leaf)
        splits, rows, tests = pairs.agg(F.count_if(is_open & ~leaf), F.sum(F.when(leaf, F.col("a_n"))),
                                        F.sum(F.when(leaf, F.col("work")))).first()
        a_hot, b_hot = (None, None) if level == deepest else (a_size.hot, b_size.hot)
        sums.append(_added(a_points, b_points, pairs, leaf, rows or 0, tests or 0, limit,
                           a_size, b_size, a_hot, b_hot, level == 0))
        if splits == 0:
            break
        if level == 0:  # deeper levels read the points of the split cells only
            def inside(points, size, side_of):
                names = cut(heavy.select(F.col(side_of + "i").alias("i"), F.col(side_of + "j").alias("j"))
                            .distinct())
                return cut(lookup(points, names, size.cells, size.hot).select("id", "x", "y"))
            a_dense = inside(a_points, a_size, "a_")
            b_dense = a_dense if same else inside(b_points, b_size, "b_")
        level += 1
        side /= 2 ** SPLIT_BITS
        a_points = _locate(a_dense, side)
        b_points = a_points if same else _locate(b_dense, side)
        b_cells = _cells(b_points)
        a_cells = b_cells if same else _cells(a_points)
        b_size = _Size(b_cells)
        a_size = b_size if same else _Size(a_cells)
        pairs = cut(_settle(_parts(heavy, a_cells, b_cells), limit))

    rows = sums[0]
    for more in sums[1:]:
        rows = rows.unionByName(more)
    # the id alone as key: this aggregate takes in a row for each pair of points in reach
    return rows.groupBy("id").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.sum("n").alias("n"))
