import math
import random

import pytest

import quillgrid.operators.kcenter as kc
import quillgrid.plans.centers as pc
from conftest import MIDDLE
from fixed import FIFTEEN
from quillgrid import queries as q


def d2(a, b):
    return (a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1])


def traverse(points, k):
    """Farthest-first over ``{id: (x, y)}`` from the lowest id, written out."""
    chosen = [min(points)]
    while len(chosen) < k:
        far = {i: min(d2(p, points[c]) for c in chosen) for i, p in points.items()}
        best = max(far.values())
        if best == 0:
            break
        chosen.append(min(i for i in far if far[i] == best))
    return chosen


def radius(points, centers):
    return math.sqrt(max(min(d2(p, points[c]) for c in centers) for p in points.values()))


def ids(centers):
    return [c[0] for c in centers]


def cloud(seed, size):
    rnd = random.Random(seed)
    return [(rnd.gauss(0, 3), rnd.choice([-2.0, 0.0, rnd.random()])) for _ in range(size)]


def test_three_points(plane):
    assert [c[1:] for c in kc.farthest_first(plane([(1, 2), (3, 4), (5, 6)]), 2)] == [(1.0, 2.0), (5.0, 6.0)]


def test_fifteen_points(plane):
    points = plane(FIFTEEN)
    centers = kc.farthest_first(points, 4)
    assert ids(centers) == [0, 14, 5, 10]
    assert round(kc.covering_radius(points, centers).first().radius, 8) == 1.17136672
    assert kc.coreset(kc.by_id(points, 2), 3).count() == 6
    by_parts = kc.coreset_centers(points, 3, 2)
    assert ids(by_parts) == [0, 14, 4]
    assert round(kc.covering_radius(points, by_parts).first().radius, 8) == 1.84610401


@pytest.mark.parametrize("k", [1, 2, 6])
def test_traversal_and_coreset(plane, k):
    pairs = cloud(k, 50)
    points, spots = plane(pairs), dict(enumerate(pairs))
    assert ids(kc.farthest_first(points, k)) == traverse(spots, k)
    core = kc.coreset(kc.by_id(points, 3), k).orderBy("g", "rank").collect()
    want = [(g, r, i) for g in range(3)
            for r, i in enumerate(traverse({i: p for i, p in spots.items() if i % 3 == g}, k))]
    assert [(r.g, r["rank"], r.id) for r in core] == want
    assert ids(kc.coreset_centers(points, k, 3)) == traverse({i: spots[i] for _, _, i in want}, k)


def test_coreset_of_many_groups_is_not_collected(plane, monkeypatch):
    pairs = cloud(9, 40)
    want = kc.coreset(kc.by_id(plane(pairs), 5), 3).collect()
    monkeypatch.setattr(kc, "COLLECTED_ROWS", 2)
    monkeypatch.setattr(kc, "BROADCAST_GROUPS", 2)
    assert sorted(kc.coreset(kc.by_id(plane(pairs), 5), 3).collect()) == sorted(want)


def test_groups_that_run_out_of_points(plane):
    points = plane([(0, 0), (1, 1), (0, 0), (5, 5), (0, 0), (9, 9)])
    core = kc.coreset(kc.by_id(points, 2), 5).orderBy("g", "rank").collect()
    assert [(r.g, r.id) for r in core] == [(0, 0), (1, 1), (1, 5), (1, 3)]


@pytest.mark.parametrize("rows", [100_000, 2])
def test_more_centers_than_are_carried(plane, monkeypatch, rows):
    """Distances are written down twice on the way."""
    monkeypatch.setattr(kc, "COLLECTED_ROWS", rows)
    monkeypatch.setattr(kc, "CARRIED", 3)
    pairs = cloud(21, 60)
    points, spots = plane(pairs), dict(enumerate(pairs))
    assert ids(kc.farthest_first(points, 8)) == traverse(spots, 8)
    core = kc.coreset(kc.by_id(points, 2), 8).orderBy("g", "rank").collect()
    assert [(r.g, r.id) for r in core] == [
        (g, i) for g in range(2) for i in traverse({i: p for i, p in spots.items() if i % 2 == g}, 8)]


def cover(rows, k):
    """Farthest-first over rows ``(id, x, y, n, radius)``, each center with what it stands for, written out."""
    spots = {r[0]: r[1:3] for r in rows}
    chosen = traverse(spots, k)
    mine = {i: min((d2(p, spots[c]), rank) for rank, c in enumerate(chosen)) for i, p in spots.items()}
    return [(rank, c, *spots[c], sum(r[3] for r in rows if mine[r[0]][1] == rank),
             max(math.sqrt(mine[r[0]][0]) + r[4] for r in rows if mine[r[0]][1] == rank)) for rank, c in enumerate(chosen)]


def tree(pairs, k, width, fan):
    """All levels of the tree, each as ``{node: rows}``."""
    level = {}
    for i, (x, y) in enumerate(pairs):
        level.setdefault(i // width, []).append((i, float(x), float(y), 1, 0.0))
    levels = [{node: cover(rows, k) for node, rows in level.items()}]
    while max(levels[-1]) > 0:
        level = {}
        for node, rows in levels[-1].items():
            level.setdefault(node // fan, []).extend(r[1:] for r in rows)
        levels.append({node: cover(rows, k) for node, rows in level.items()})
    return levels


@pytest.mark.parametrize("parts", [1, 5])
@pytest.mark.parametrize("width, fan", [(200, 16), (31, 2), (7, 3), (1, 2)])
def test_tree_of_coresets(plane, parts, width, fan):
    pairs = cloud(11, 120)
    points, spots = plane(pairs, parts), dict(enumerate(pairs))
    levels = tree(pairs, 4, width, fan)
    leaves = kc.split_coresets(points, 4, width)
    assert sorted(map(tuple, leaves.collect())) == sorted((node, *r) for node, rows in levels[0].items() for r in rows)
    root = sorted(map(tuple, kc.merged_coresets(leaves, 4, fan).collect()))
    assert root == [(0, *r) for r in levels[-1][0]]
    # the cover holds: all points are counted, and none is farther away than it says
    assert sum(r[5] for r in root) == 120
    assert all(min(math.sqrt(d2(p, r[3:5])) - r[6] for r in root) <= 1e-9 for p in spots.values())
    assert radius(spots, [r[2] for r in root]) <= max(r[6] for r in root) + 1e-9


def test_tree_does_not_depend_on_the_lowest_id(spark):
    rows = [(i - 1000, float(i % 13), float(i % 7)) for i in range(90)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    leaves = kc.split_coresets(points, 3, 20)
    assert sorted(r.node for r in leaves.select("node").distinct().collect()) == [0, 1, 2, 3, 4]
    assert [r[2] + 1000 for r in sorted(kc.merged_coresets(leaves, 3).collect())] == [
        r[1] for r in tree([(x, y) for _, x, y in rows], 3, 20, 16)[-1][0]]


def test_one_split_is_the_plain_traversal(plane):
    pairs = cloud(12, 60)
    assert ids(kc.coreset_centers(plane(pairs, 3), 5)) == traverse(dict(enumerate(pairs)), 5)
    with pytest.raises(ValueError):
        kc.split_coresets(plane(pairs), 5, 0)
    with pytest.raises(ValueError):
        kc.merged_coresets(kc.split_coresets(plane(pairs), 5), 5, 1)


def test_more_centers_than_points(plane):
    same = plane([(2, 2)] * 5)
    assert ids(kc.farthest_first(same, 3)) == [0]
    assert ids(kc.coreset_centers(same, 3)) == [0]
    assert kc.covering_radius(same, kc.farthest_first(same, 3)).first().radius == 0
    assert ids(kc.farthest_first(plane([(0, 0), (1, 0), (0, 0)]), 9)) == [0, 1]
    with pytest.raises(ValueError):  # no grid of width 0
        kc.radius_outliers(same, 3, 1)


def test_seeded_start(plane):
    points = plane(FIFTEEN)
    starts = {kc.farthest_first(points, 1, seed)[0][0] for seed in range(6)}
    assert len(starts) > 1
    assert kc.farthest_first(points, 4, 3) == kc.farthest_first(points.repartition(5), 4, 3)


def test_nearest_center(plane, monkeypatch):
    pairs = cloud(13, 40)
    points, spots = plane(pairs), dict(enumerate(pairs))
    centers = kc.farthest_first(points, 4) + [(99, *pairs[0])]
    want = {i: min((d2(p, c[1:]), r) for r, c in enumerate(centers)) for i, p in spots.items()}
    for unrolled in (64, 2):
        monkeypatch.setattr(kc, "UNROLLED", unrolled)
        assert {r.id: (r.d2, r.center) for r in kc.nearest_center(points, centers).collect()} == want
        assert kc.covering_radius(points, centers).first().radius == math.sqrt(max(want.values())[0])


def test_no_points_and_bad_arguments(plane):
    nothing = plane(FIFTEEN).filter("false")
    assert kc.global_centers(nothing, 3).count() == kc.coreset(kc.by_id(nothing, 2), 3).count() == 0
    assert kc.mapreduce_centers(nothing, 3).count() == 0
    with pytest.raises(ValueError):
        kc.covering_radius(nothing, [])
    for k in (0, -1, 2.0):
        with pytest.raises(ValueError):
            kc.farthest_first(plane(FIFTEEN), k)


@pytest.mark.parametrize("source, k, want, r", [
    ("embedding_points", 5, [0, 392, 328, 356, 336], 0.26689824),
    ("embedding_points", 8, [0, 392, 201, 356, 25, 78, 106, 108], 0.22423123),
    ("order_points", 6, [0, 1028, 14239, 5808, 3136, 11376], 119.66164403)])
def test_golden_numbers(spark, source, k, want, r):
    points = getattr(q, source)(spark, MIDDLE)
    centers = kc.coreset_centers(points, k, 4)
    assert ids(centers) == want
    assert round(kc.covering_radius(points, centers).first().radius, 8) == r


@pytest.mark.parametrize("shape", ["spread", "line", "lattice", "one spot", "far one"])
def test_nearest_of_many_centers(plane, shape):
    """The grid of centers answers as a comparison with every center does, ties included."""
    rnd = random.Random(5)
    spot = {"spread": lambda: (rnd.uniform(0, 9), rnd.uniform(0, 5)), "line": lambda: (rnd.uniform(-4, 4), 2.0),
            "lattice": lambda: (rnd.randint(0, 9), rnd.randint(0, 9)), "one spot": lambda: (3.0, 3.0),
            "far one": lambda: (rnd.random(), rnd.random())}[shape]
    centers = [(k, *map(float, spot())) for k in range(300)] + ([(300, 1e6, -1e6)] if shape == "far one" else [])
    pairs = [spot() for _ in range(300)] + [(rnd.uniform(-30, 30), rnd.uniform(-30, 30)) for _ in range(60)]
    pairs += [(0.5 + k % 9, 0.5 + k // 9) for k in range(40)] + [(1e9, 1e9), (-1e9, 3.0), (0.0, 0.0)]
    want = {i: min((d2(p, c[1:]), r) for r, c in enumerate(centers)) for i, p in enumerate(pairs)}
    points = plane(pairs)
    assert {r.id: (r.d2, r.center) for r in kc.nearest_center(points, centers).collect()} == want
    assert kc.covering_radius(points, centers).first().radius == math.sqrt(max(want.values())[0])
    assert len(pc.center_grid([c[1:] for c in centers]).starts) <= 3 * len(centers) + 3
