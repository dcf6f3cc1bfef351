"""Borders, polygons, growth, corridors and parallel merges against plain forms."""

import numpy as np
import pytest
from broadsheet.operators import contours, geometry, growth, planes, repair
from hypothesis import given, settings
from hypothesis import strategies as st

MASKS = st.tuples(st.integers(1, 9), st.integers(1, 9)).flatmap(lambda s: st.lists(st.booleans(), min_size=s[0] * s[1], max_size=s[0] * s[1]).map(lambda v: np.array(v).reshape(s)))


def flood(mask, around):
    """Number of each cell's part by plain flooding, 0 elsewhere."""
    out, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if out[start]:
            continue
        n += 1
        todo = [start]
        out[start] = n
        while todo:
            y, x = todo.pop()
            for dy, dx in around:
                a = (y + dy, x + dx)
                if 0 <= a[0] < mask.shape[0] and 0 <= a[1] < mask.shape[1] and mask[a] and not out[a]:
                    out[a] = n
                    todo.append(a)
    return out


FOUR = [(0, 1), (1, 0), (0, -1), (-1, 0)]
EIGHT = FOUR + [(1, 1), (1, -1), (-1, 1), (-1, -1)]


@settings(max_examples=150, deadline=None)
@given(MASKS)
def test_borders_by_flooding(mask):
    found = contours.borders(mask)
    parts = flood(mask, EIGHT)
    ground = flood(~np.pad(mask, 1), FOUR)
    for k in range(1, parts.max() + 1):
        own = [b for b in found if b.region == k]
        cells = parts == k
        assert sum(contours.signed_area(b.corners) for b in own) == cells.sum()
        assert [b.outer for b in own].count(True) == 1
        # the ground about a region falls into its outside and its holes
        around = flood(~np.pad(cells, 1), FOUR)
        assert len(own) == around.max()
        y, x = (v[0] for v in np.nonzero(cells))
        assert [b.external for b in own if b.outer] == [ground[y, x + 1] == 1]
        outer = next(b for b in own if b.outer)
        assert contours.signed_area(outer.corners) == (around != 1).sum()
        rim = {(x, y) for y, x in zip(*np.nonzero(cells), strict=True) if any(around[y + 1 + dy, x + 1 + dx] == 1 for dy, dx in FOUR)}
        assert {tuple(c) for c in outer.cells.tolist()} == rim
        steps = np.abs(np.roll(outer.cells, -1, 0) - outer.cells).max(1)
        assert (steps <= 1).all()


def test_polygons_have_area_and_holes_hold_none():
    mask = np.zeros((40, 40), bool)
    mask[5:30, 5:30] = True
    mask[8:27, 8:27] = False
    mask[12:22, 12:22] = True  # in the hole of the first
    mask[33:35, 33:35] = True  # too small
    (ring,) = contours.polygons_of(mask)
    assert geometry.area_of(ring) == 24 * 24
    assert len(contours.polygons_of(mask, least=0.5, tolerance=None)) == 2


@settings(max_examples=150, deadline=None)
@given(MASKS, st.sampled_from([0.5, 1.0, 2.0]))
def test_simplified_rings_stay_whole_and_near(mask, tolerance):
    for b in contours.borders(mask):
        ring = b.corners.astype(float)
        if len({tuple(p) for p in ring.tolist()}) < len(ring):
            continue  # it meets itself at a corner
        out = contours.simplified_ring(ring, tolerance, whole=True)
        assert len(contours._crossings(out)) == 0 and set(map(tuple, out.tolist())) <= set(map(tuple, ring.tolist()))
        for p in ring:
            assert repair.path_distance(p[None], np.vstack((out, out[:1]))) <= tolerance + 1e-9
    assert len(contours.simplified_ring(np.array([(0, 0), (9, 0), (9, 0.5), (0, 0.5)]), 1.0)) == 0


def test_ellipse_of_even_and_odd_sides():
    rows = lambda w, h: [sorted(dx for dy, dx in growth.ellipse(w, h) if dy == k) for k in sorted({dy for dy, _ in growth.ellipse(w, h)})]
    assert rows(5, 5) == [[0], [-2, -1, 0, 1, 2], [-2, -1, 0, 1, 2], [-2, -1, 0, 1, 2], [0]]
    assert rows(10, 3) == [[0], list(range(-5, 5)), [0]]
    assert rows(3, 1) == [[-1, 0, 1]]


@settings(max_examples=80, deadline=None)
@given(MASKS, st.sampled_from([(3, 3), (5, 3), (4, 5), (10, 3)]))
def test_kernels_by_loops(mask, size):
    k, (h, w) = growth.ellipse(*size), mask.shape
    at = lambda m, y, x, beyond: m[y, x] if 0 <= y < h and 0 <= x < w else beyond
    wide = np.array([[any(at(mask, y + dy, x + dx, False) for dy, dx in k) for x in range(w)] for y in range(h)])
    thin = np.array([[all(at(wide, y + dy, x + dx, True) for dy, dx in k) for x in range(w)] for y in range(h)])
    assert (growth.spread_by(mask, k) == wide).all() and (growth.closed_by(mask, k) == thin).all()
    parts = flood(mask, FOUR)
    keep = np.isin(parts, [i for i in range(1, parts.max() + 1) if (parts == i).sum() >= 3])
    assert (growth.without_specks(mask, 3) == keep).all()


def test_growth_stays_behind_its_stoppers(spark):
    page = np.zeros((30, 60), np.uint8)
    page[10:16, 5:20] = 2
    page[:, 30:42] = 9  # wider than a kernel, which would step over it
    page[2, 50] = 2  # a speck
    how = growth.Growth((1, 2), (growth.Stopper((9,)),), (9, 5), snapshots=(1, 8), least=15)
    df = spark.createDataFrame([(1, 30, 60, bytearray(page.tobytes())), (2, 30, 60, None)], "page long, height int, width int, data binary")
    got = {(r["page"], r["round"]): np.frombuffer(r["data"], np.uint8).reshape(30, 60) for r in growth.region_growth(df, how).collect()}
    assert got[1, 1].sum() > (page == 2).sum() and got[1, 8].sum() > got[1, 1].sum()
    assert not got[1, 8][:, 30:].any() and got[1, 8][:, 29].any() and not got[2, 8].any()
    hulls = {(r["page"], r["round"]): np.frombuffer(r["data"], np.uint8).reshape(30, 60) for r in growth.region_growth(df, how, hulls=True).collect()}
    assert (hulls[1, 1] >= got[1, 1]).all() and growth.region_growth(df.limit(0), how).count() == 0
    # the composed settings: text grows up to its separators, tables leave text alone
    text, = growth.grown(page, growth.TEXT_BLOCKS)
    assert text.any() and not text[:, 30:42].any()
    assert not growth.grown(page, growth.TABLES)[1].any()


@settings(max_examples=80, deadline=None)
@given(MASKS)
def test_hulls_are_filled(mask):
    out = growth.filled_hulls(mask)
    assert (out >= mask).all()
    for b in contours.borders(out):
        ring = geometry.hull_of(b.cells)
        assert not b.external or len(ring) < 3 or geometry.area_of(ring) <= mask.size


def test_corridors_guard_joins():
    plane = np.zeros((60, 200), np.uint8)
    plane[20, 60:80] = 2
    paths = [np.array([(0, 20), (50, 20)], float), np.array([(100, 20), (150, 20)], float), np.array([(155, 22), (190, 22)], float)]
    got = repair.joined_segments(paths, [8, 8, 8], [2.0] * 3, plane.copy())
    assert [m for m, *_ in got] == [[0], [1, 2]]
    free = np.zeros((60, 200), np.uint8)
    got = repair.joined_segments(paths, [8, 8, 8], [2.0] * 3, free)
    assert [m for m, *_ in got] == [[0, 1, 2]] and (free[20, 51:100] == 8).all()
    assert [m for m, *_ in repair.joined_segments(paths, [8, 9, 8], [2.0] * 3, plane * 0)] == [[0, 2], [1]]
    # table text in the way of a line is let pass where the line has more cells of its own
    for own, text, want in ((8, 5, True), (8, 2, False), (9, 4, True), (9, 5, False)):
        labels = np.array([own] * 5 + [text] * 3 + [0, 6])
        assert repair.is_free(labels, own) == want
    assert not repair.is_free(np.array([8, 5]), 8) and repair.is_free(np.array([5, 8, 7]), 7, (5, 8))
    # a table column has a second, wider corridor, narrow where a vertical line runs beside it
    column = [np.array([(100, 0), (100, 15)], float), np.array([(100, 45), (100, 59)], float)]
    beside = np.zeros((60, 200), np.uint8)
    beside[28:32, 120:130] = 2
    assert len(repair.joined_segments(column, [7, 7], [1.0, 1.0], beside.copy())) == 2
    beside[:, 110] = 9
    assert len(repair.joined_segments(column, [7, 7], [1.0, 1.0], beside)) == 1


def test_parallel_test_is_one_parameter():
    far = np.array([(0, 0, 100, 0), (104, 24, 200, 24)], float)
    assert geometry.greedy_endpoint_merges(far, 500) == [(0, 1)]
    assert not geometry._greedy_chains(far, 500, True, True)[0]
    assert len(repair.joined_segments([r.reshape(2, 2) for r in far], [8, 8], [1, 1], np.zeros((40, 220), np.uint8), own_lengths=True)) == 2


def dense(path, n=60):
    t = np.linspace(0, len(path) - 1, n * (len(path) - 1) + 1)
    i = np.minimum(t.astype(int), len(path) - 2)
    return path[i] + (t - i)[:, None] * (path[i + 1] - path[i])


@pytest.mark.parametrize("seed", range(12))
def test_path_distance_by_points(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.uniform(0, 60, (rng.integers(2, 5), 2)), rng.uniform(0, 60, (rng.integers(2, 5), 2))
    plain = np.hypot(*(dense(a)[:, None] - dense(b)[None]).transpose(2, 0, 1)).min()
    assert plain - 1.5 <= repair.path_distance(a, b) <= plain + 1e-9


def plain_merges(points, distance, buffer):
    """Every pair in every round, by plain flooding."""
    live = [([i], p) for i, p in enumerate(points)]
    while True:
        paths = [geometry.polyline_of(p)[0] for _, p in live]
        near = lambda a, b: (a.min(0) <= b.max(0) + buffer).all() and (b.min(0) <= a.max(0) + buffer).all() and repair.path_distance(a, b) <= distance
        left, out = set(range(len(live))), []
        for i in range(len(live)):
            if i in left:
                left.discard(i)
                group, todo = [i], [i]
                while todo:
                    k = todo.pop()
                    met = [j for j in left if near(paths[k], paths[j])]
                    left -= set(met)
                    group += met
                    todo += met
                out.append((sorted(m for g in group for m in live[g][0]), np.unique(np.concatenate([live[g][1] for g in group]), axis=0)))
        if len(out) == len(live):
            return sorted(m for m, _ in live)
        live = out


@pytest.mark.parametrize("seed", range(8))
def test_parallel_merges_by_all_pairs(seed):
    rng = np.random.default_rng(seed)
    starts, steps = rng.uniform(0, 90, (25, 2)), rng.uniform(-12, 12, (25, 2))
    points = [np.unique(np.rint(s + np.linspace(0, 1, 15)[:, None] * v), axis=0) for s, v in zip(starts, steps, strict=True)]
    points = [p if len(p) > 1 else np.vstack((p, p + 1)) for p in points]
    assert sorted(m for m, *_ in repair.merged_parallel(points, 5.0, 1.0)) == plain_merges(points, 5.0, 1.0)


def test_repair_as_tables(spark):
    plane = np.zeros((40, 220), np.uint8)
    df = planes.packed(spark.createDataFrame([(1, 20, 70, 2), (2, 1, 1, 3)], "page long, y int, x int, label int"), 40, 220)
    rows = [(1, 8, 7, 0, 20, 50, 20), (1, 8, 8, 90, 20, 140, 20), (1, 8, 9, 150, 20, 200, 20), (3, 9, 4, 5, 0, 5, 9), (3, 9, 5, 5, 12, 5, 30)]
    seg = spark.createDataFrame([(*r[:3], *map(float, r[3:]), 1.0) for r in rows], "page long, label int, id long, x0 double, y0 double, x1 double, y1 double, thickness double")
    got = {(r["page"], r["id"]): (r["members"], [(p["x"], p["y"]) for p in r["path"]]) for r in repair.repaired_segments(seg, df).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, 7): [7], (1, 8): [8, 9], (3, 4): [4, 5]}
    assert repair.repaired_segments(seg.limit(0), df).count() == 0 and not plane.any()
    line = lambda y, a, b: [{"x": float(x), "y": float(y)} for x in range(a, b)]
    points = spark.createDataFrame([(1, 8, 1, line(5, 0, 30)), (1, 8, 2, line(6, 10, 40)), (1, 9, 3, line(7, 10, 40)), (1, 8, 4, line(30, 0, 9)), (1, 8, 5, [])], "page long, label int, id long, points array<struct<x: double, y: double>>")
    assert sorted((r["label"], r["members"]) for r in repair.parallel_merges(points).collect()) == [(8, [1, 2]), (8, [4]), (9, [3])]
