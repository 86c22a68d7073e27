import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import quillgrid.plans.hot as hot
import quillgrid.plans.within as within
from conftest import MIDDLE
from fixed import FIFTEEN
from quillgrid import queries as q
from quillgrid.operators import grid, outliers
from quillgrid.plans.within import count_within


def brute(pairs, distance, among=None):
    limit = distance * distance
    return [sum((x - u) * (x - u) + (y - v) * (y - v) <= limit for u, v in pairs) for x, y in among or pairs]


def counted(df):
    return [r.n for r in sorted(df.collect())]


def clouds(seed, sizes, spread=0.3):
    """Clouds of points of very different density, with copies, on both sides of zero."""
    rnd = random.Random(seed)
    out = []
    for k, size in enumerate(sizes):
        cx, cy, r = 4 * k - 5, (-1) ** k * 2, spread * (k + 1) / len(sizes)
        out += [(rnd.gauss(cx, r), rnd.gauss(cy, r)) for _ in range(size)]
    out += out[:10] * 3 + [(-3.0, -3.0)] * 50 + [(-3.0, -2.0)] * 40
    return out


@pytest.fixture
def tiny_limits(monkeypatch):
    """Make a few points count as hot, heavy and too many to broadcast."""
    monkeypatch.setattr(hot, "HOT_FLOOR", 20)
    monkeypatch.setattr(hot, "HOT_SHARE", 10 ** 9)
    monkeypatch.setattr(hot, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(within, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(within, "LEAF_PAIRS", 16)
    monkeypatch.setattr(within, "TASK_TESTS", 50)
    monkeypatch.setattr(within, "BROADCAST_POINTS", 3)


CASES = {
    "fifteen": (FIFTEEN, 1.0),
    "one point": ([(0.0, 0.0)], 1.0),
    "all equal": ([(2.5, -1.5)] * 60, 0.1),
    "exactly D apart": ([(0.0, 0.0), (3.0, 4.0), (3.0, -4.0), (-5.0, 0.0), (5.0, 0.0001)], 5.0),
    "on cell borders": ([(i * 0.5, j * 0.5) for i in range(-4, 5) for j in range(-4, 5)], 0.5),
    "clouds": (clouds(1, [120, 60, 5]), 0.5),
    "dense against D": (clouds(2, [150, 80]), 2.0),
    "far from zero": ([(1e9 + i / 8, -1e9 + (i % 7) / 4) for i in range(60)], 0.75),
}


@pytest.mark.parametrize("name", CASES)
def test_neighbour_counts(plane, name):
    pairs, distance = CASES[name]
    assert counted(outliers.neighbour_counts(plane(pairs), distance)) == brute(pairs, distance)


@pytest.mark.parametrize("name", CASES)
def test_neighbour_counts_with_hot_cells(plane, tiny_limits, name):
    pairs, distance = CASES[name]
    assert counted(outliers.neighbour_counts(plane(pairs), distance)) == brute(pairs, distance)


@pytest.mark.parametrize("name", ["fifteen", "clouds", "on cell borders", "far from zero"])
def test_neighbour_counts_with_cells_sent_to_all_tasks(plane, tiny_limits, monkeypatch, name):
    monkeypatch.setattr(within, "BROADCAST_POINTS", 1 << 21)
    pairs, distance = CASES[name]
    assert counted(outliers.neighbour_counts(plane(pairs), distance)) == brute(pairs, distance)


@pytest.mark.parametrize("small, matrix", [(1 << 12, 1 << 15), (0, 1 << 15), (100, 64), (1 << 12, 1)])
def test_runs_of_points_are_compared_whole(monkeypatch, small, matrix):
    monkeypatch.setattr(within, "SMALL", small)
    monkeypatch.setattr(within, "MATRIX", matrix)
    draw = np.random.default_rng(3)
    a_size, b_size = draw.integers(0, 30, 40), draw.integers(0, 30, 40)
    a_at, b_at = (np.append(0, np.cumsum(n)) for n in (a_size, b_size))
    (ax, ay), (bx, by) = (draw.integers(0, 6, (2, at[-1])).astype(float) for at in (a_at, b_at))
    want = [sum((ax[k] - bx[m]) ** 2 + (ay[k] - by[m]) ** 2 <= 5.0 for m in range(b_at[run], b_at[run + 1]))
            for run in range(40) for k in range(a_at[run], a_at[run + 1])]
    assert within._close_pairs(ax, ay, a_at, bx, by, b_at, 5.0).tolist() == want


@pytest.mark.parametrize("name", ["fifteen", "clouds", "exactly D apart"])
def test_exact_outliers_with_hot_cells(plane, tiny_limits, name):
    pairs, distance = CASES[name]
    for m in (0, 1, 3, 8):
        want = sum(n <= m for n in brute(pairs, distance))
        assert outliers.count_exact_outliers(plane(pairs), distance, m).first()[0] == want


def test_counts_of_other_points(plane, tiny_limits):
    pairs = clouds(5, [90, 40])
    among = [(100.0, 100.0), (-5.0, 2.0), (-3.0, -3.0), (-1.0, -2.0)]
    assert counted(count_within(plane(among), plane(pairs), 1.0)) == brute(pairs, 1.0, among)


def test_depth_limit_still_exact(plane, tiny_limits, monkeypatch):
    pairs = clouds(6, [80])
    monkeypatch.setattr(within, "DEEPEST", 1)
    assert counted(outliers.neighbour_counts(plane(pairs), 0.5)) == brute(pairs, 0.5)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.floats(-20, 20), st.floats(-20, 20)), min_size=1, max_size=40),
       st.sampled_from([0.5, 1.0, 3.0]), st.integers(0, 6))
def test_bounds_enclose_the_exact_number(plane, pairs, distance, m):
    points = plane(pairs)
    row = outliers.outlier_report(points, distance, m).first()
    assert row.exact == sum(n <= m for n in brute(pairs, distance))
    assert row.sure <= row.exact <= row.sure + row.uncertain


@pytest.mark.parametrize("distance, m, exact, sure, uncertain", [
    (1.0, 3, 9, 7, 4), (1.0, 2, 8, 0, 8), (0.5, 2, 8, 8, 3), (2.0, 5, 7, 3, 6), (1.0, 0, 0, 0, 0)])
def test_fifteen_points(plane, distance, m, exact, sure, uncertain):
    row = outliers.outlier_report(plane(FIFTEEN), distance, m).first()
    assert (row.exact, row.sure, row.uncertain) == (exact, sure, uncertain)


def test_fifteen_points_in_order(plane):
    points = plane(FIFTEEN)
    top = outliers.top_outliers(points, 1.0, 3, 20).collect()
    assert [r.id for r in top] == [1, 12, 4, 5, 10, 11, 13, 14, 0]
    assert [r.n for r in top] == [1, 1, 2, 2, 2, 2, 2, 2, 3]
    assert [r.id for r in outliers.top_outliers(points, 1.0, 3, 2).collect()] == [1, 12]
    assert outliers.top_outliers(points, 1.0, 3, 0).count() == 0
    cells = [tuple(r) for r in grid.smallest_cells(points, 1.0, 11).collect()]
    assert cells == [(1, 2, 1), (1, 11, 1), (2, 2, 1), (2, 3, 1), (4, 9, 1), (4, 10, 1), (9, 13, 1),
                     (11, 11, 1), (12, 12, 1), (3, 14, 2), (4, 3, 4)]


def test_neighbourhoods_across_tiles(spark):
    rnd = random.Random(4)
    cells = {(rnd.randint(-70, 70), rnd.choice([-64, -63, -1, 0, 1, 2, 61, 62, 63, 64, 65, 128])): rnd.randint(1, 9)
             for _ in range(400)}
    df = spark.createDataFrame([(i, j, n) for (i, j), n in cells.items()], "i long, j long, n long")

    def block(i, j, r):
        return sum(n for (a, b), n in cells.items() if abs(a - i) <= r and abs(b - j) <= r)

    got = sorted(tuple(r) for r in grid.neighbourhoods(df).collect())
    assert got == sorted((i, j, n, block(i, j, 1), block(i, j, 3)) for (i, j), n in cells.items())


def test_negative_coordinates_have_their_own_cells(plane):
    cells = {(r.i, r.j) for r in grid.point_cells(plane([(-0.1, 0.1), (0.1, -0.1)]), 1.0).collect()}
    assert cells == {(-1, 0), (0, -1)}


def test_golden_embeddings_and_lines(spark):
    e = q.embedding_points(spark, MIDDLE)
    assert tuple(outliers.outlier_report(e, 0.05, 5).first()) == (64, 18, 150)
    assert tuple(outliers.outlier_report(e, 0.05, 3).first()) == (32, 8, 97)
    assert tuple(outliers.outlier_report(e, 0.1, 10).first()) == (14, 2, 88)
    assert grid.cell_histogram(e, 0.05).count() == 340
    lines = q.line_points(spark, MIDDLE)
    assert tuple(grid.approximate_outliers(lines, 0.5, 3).first()) == (6, 3486)
    assert grid.cell_histogram(lines, 0.5).count() == 25723


def test_no_points(plane):
    nothing = plane(FIFTEEN).filter("false")
    assert tuple(outliers.outlier_report(nothing, 1.0, 3).first()) == (0, 0, 0)
    assert outliers.neighbour_counts(nothing, 1.0).count() == 0
    assert grid.count_points(nothing).first()[0] == 0


@pytest.mark.parametrize("distance, m", [(0, 3), (-1.0, 3), (float("nan"), 3), (1.0, -1), (1.0, 1.5), (1.0, True)])
def test_bad_arguments(plane, distance, m):
    with pytest.raises(ValueError):
        outliers.outlier_report(plane(FIFTEEN), distance, m)


def test_points_on_the_rim_of_a_block(plane):
    """Rounding puts two points into one 3x3 block though they are just out of reach."""
    pairs = [(-1.007273609800237,) * 2, (1.0072736098002368,) * 2]
    assert brute(pairs, 2.849) == [1, 1]
    assert outliers.count_exact_outliers(plane(pairs), 2.849, 1).first()[0] == 2
    assert outliers.outlier_report(plane(pairs), 2.849, 1).first().exact == 2


def test_many_rims(spark):
    """1000 drawn distances at once: clusters far from each other, each scaled to the same distance by its own factor."""
    rnd, distance, wrong = random.Random(8), 1.0, 0
    side = distance / (2 * math.sqrt(2))
    pairs = []
    for k in range(1000):
        i, j = rnd.randint(-40, 40) * 50 + k % 7, rnd.randint(-40, 40) * 50
        low = lambda c: c * side * (1 + rnd.choice([0, 1, -1, 2]) * 2.0 ** -52)
        pairs += [(low(i), low(j)), (low(i + 2), low(j + 2)), (low(i + 2), low(j))]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "id long, x double, y double")
    want = brute(pairs, distance)
    for m in (1, 2):
        got = {r.id for r in outliers.exact_outliers(points, distance, m).collect()}
        assert got == {k for k, n in enumerate(want) if n <= m}


def test_coordinates_too_far_for_cells(plane):
    far = plane([(1e25, 0.0), (3e25, 0.0), (7e25, 0.0)])
    for operator in (grid.cell_histogram, outliers.neighbour_counts):
        with pytest.raises(Exception, match="2\\^52"):
            operator(far, 1.0).collect()
    with pytest.raises(Exception, match="2\\^52"):
        grid.approximate_outliers(far, 1.0, 1).collect()
    x = 2.0 ** 46
    pairs = [(x, 0.0), (x + 1, 0.0), (x + 2, 0.0), (-x, 0.5), (-x, 1.5)]
    assert counted(outliers.neighbour_counts(plane(pairs), 1.0)) == brute(pairs, 1.0)


def test_a_large_cell_that_is_not_hot(spark, monkeypatch):
    """A third of the points in one cell: none of them reaches the tasks that compare points."""
    monkeypatch.setattr(within, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(hot, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(within, "LEAF_PAIRS", 64)
    pairs = [(0.5, 0.5)] * 300 + [(10.0 + k, 3.0 * (k % 5)) for k in range(300)] + clouds(6, [120, 60])
    points = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(pairs)], "id long, x double, y double")
    assert counted(outliers.neighbour_counts(points, 1.5)) == brute(pairs, 1.5)


@pytest.mark.parametrize("strip, swept", [(4, 1 << 18), (0.1, 1), (1, 50)])
def test_a_sweep_counts_like_pairs(monkeypatch, strip, swept):
    monkeypatch.setattr(within, "STRIP", strip)
    monkeypatch.setattr(within, "SWEPT", swept)
    draw = np.random.default_rng(4)
    clouded = draw.normal(0, 1, (2, 300)) * draw.choice([1e-3, 1, 4], 300)
    for a, b, limit in [(clouded[:, :120], clouded, 2.25),
                        (draw.integers(-6, 6, (2, 150)).astype(float), draw.integers(-6, 6, (2, 400)).astype(float), 25.0),
                        (draw.integers(0, 9, (2, 90)) / 4 + 1e9, draw.integers(0, 9, (2, 90)) / 4 + 1e9, 0.5625),
                        (draw.integers(0, 30, (2, 200)) * 0.1, draw.integers(0, 30, (2, 200)) * 0.1, 0.5 * 0.5),
                        (clouded, np.zeros((2, 70)), 1e-6), (clouded, np.empty((2, 0)), 1.0)]:
        (ax, ay), (bx, by) = a, b
        want = [sum((x - u) * (x - u) + (y - v) * (y - v) <= limit for u, v in zip(bx, by)) for x, y in zip(ax, ay)]
        assert within._sweep(ax, ay, bx, by, limit).tolist() == want


@pytest.mark.parametrize("name", ["clouds", "dense against D", "on cell borders", "exactly D apart"])
@pytest.mark.parametrize("facing", [1, 1 << 20])
def test_large_cells_are_swept(plane, monkeypatch, name, facing):
    for limit, value in (("BROADCAST_ROWS", 3), ("LEAF_PAIRS", 4), ("FACING_POINTS", facing), ("TASK_POINTS", 100)):
        monkeypatch.setattr(within, limit, value)
    pairs, distance = CASES[name]
    assert counted(outliers.neighbour_counts(plane(pairs), distance)) == brute(pairs, distance)


def test_a_point_goes_to_few_keys_however_many_it_reaches(plane, monkeypatch):
    """Cells that a task can hold are not split, so a denser cloud does not send its points to more keys."""
    monkeypatch.setattr(within, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(within, "LEAF_PAIRS", 64)
    draw = np.random.default_rng(5)
    levels = []
    located = within._locate
    monkeypatch.setattr(within, "_locate", lambda points, side: levels.append(side) or located(points, side))
    pairs = list(zip(*draw.uniform(0, 4, (2, 400))))
    assert counted(outliers.neighbour_counts(plane(pairs), 1.0)) == brute(pairs, 1.0)
    assert levels == [2.0]
