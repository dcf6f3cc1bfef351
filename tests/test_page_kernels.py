"""Kernels over many pages at once against plain forms, and plans that read and shuffle no more than they must."""

import contextlib
import io
from pathlib import Path

import numpy as np
import pytest
from broadsheet.operators import contours, curves, cuts, geometry, growth, overlays, planes, rasters, repair, warps
from broadsheet.plans import registry

SF = Path("/root/testdata/sf0.001")
registry.load()
needs_tables = pytest.mark.skipif(not SF.exists(), reason="no test tables here")


def plan(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        registry.QUERIES[name](spark, str(SF)).explain()
    return out.getvalue()


@needs_tables
def test_block_lines_traces_borders_once(spark):
    text = plan(spark, "block_lines")
    assert text.count("Scan parquet") == 1 and "CoGroup" not in text


def test_lined_blocks_equal_blocks_by_baselines(spark):
    rng = np.random.default_rng(3)
    rows, lines = [], []
    for i in range(30):
        ring = contours.borders(rng.random((8, 8)) < 0.6)[0].corners.astype(float)
        own = [[float(v) for v in (0, k * 2 + 0.5, 8, k * 2 + 1)] for k in range(i % 4)]
        rows.append((i % 3, i, ring[:, 0].tolist(), ring[:, 1].tolist(), own))
        lines += [(i % 3, i, k, *s) for k, s in enumerate(own)]
    df = spark.createDataFrame(rows, "page long, id long, x array<double>, y array<double>, lines array<struct<x0: double, y0: double, x1: double, y1: double>>")
    baselines = spark.createDataFrame(lines, "page long, block long, line long, x0 double, y0 double, x1 double, y1 double")
    want, got = (sorted(map(tuple, f.collect())) for f in (cuts.block_lines(df.drop("lines"), baselines), cuts.lined_blocks(df)))
    assert got == want and len(got) > 30


def test_borders_of_pages_together_are_those_of_each(spark):
    rng = np.random.default_rng(4)
    pages = [(i, h, w, (rng.random((h, w)) < 0.5).astype(np.uint8)) for i, (h, w) in enumerate([(5, 9), (12, 4), (1, 1), (7, 7), (3, 20)])]
    df = spark.createDataFrame([(i, h, w, bytearray(m.tobytes())) for i, h, w, m in pages], planes._PLANE).coalesce(1)
    got = sorted((r["page"], r["border"], r["region"], r["outer"], r["external"], r["sides"], r["x"], r["y"]) for r in contours.region_borders(df).collect())
    want = [(i, k, b.region, b.outer, b.external, b.sides, b.corners[:, 0].tolist(), b.corners[:, 1].tolist()) for i, _, _, m in pages for k, b in enumerate(contours.borders(m))]
    assert got == want


def test_the_greatest_label_of_a_cell_is_kept(spark):
    df = spark.createDataFrame([(1, 2, 3, 4), (1, 2, 3, 9), (1, 2, 3, 7), (1, 0, 0, 1)], "page long, y int, x int, label int")
    assert sorted(map(tuple, planes.unpacked(planes.packed(df, 4, 5)).collect())) == [(1, 0, 0, 1), (1, 2, 3, 9)]


def near_by_hand(rows, plane, reach):
    out = []
    for _, label, a, _, _, ax, ay, t in rows:
        for _, other, b, bx, by, *_ in rows:
            if label == other and a != b and (bx - ax if label == 8 else by - ay) >= 0 and np.hypot(bx - ax, by - ay) < reach:
                out.append((1, a, b, plane is None or repair.free_corridor(plane, label, (ax, ay), (bx, by), t)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_near_guards_by_hand(spark, seed):
    rng = np.random.default_rng(seed)
    plane = rng.choice(13, (30, 30), p=[0.88, *[0.01] * 12]).astype(np.uint8)
    rows = [(1, int(rng.choice((7, 8, 9))), i, *map(float, rng.integers(0, 32, 2)), *map(float, rng.integers(0, 32, 2)), float(rng.integers(1, 4))) for i in range(40)]
    s = spark.createDataFrame(rows, "page long, label int, id long, x0 double, y0 double, x1 double, y1 double, thickness double")
    p = spark.createDataFrame([(1, 30, 30, bytearray(plane.tobytes()))], planes._PLANE)
    got = sorted(map(tuple, repair.near_guards(s, p, 12.0).collect()))
    assert got == near_by_hand(rows, plane, 12.0) and 0 < sum(r[3] for r in got) < len(got)
    assert sorted(map(tuple, repair.near_guards(s, p.limit(0), 12.0).collect())) == near_by_hand(rows, None, 12.0)


@needs_tables
def test_corridor_guards_shuffle_no_pairs(spark):
    text = plan(spark, "corridor_guards")
    assert "CoGroup" not in text and text.count("hashpartitioning") == 2


def joined_by_hand(paths, labels, thickness, plane, reach):
    """Joins one by one with the plain tests of one pair."""
    chain = {i: ([i], p, t) for i, (p, t) in enumerate(zip(paths, thickness, strict=True))}
    n = range(len(paths))
    near = sorted((float(np.hypot(*(paths[j][0] - paths[i][-1]))), i, j) for i in n for j in n if i != j and labels[i] == labels[j])
    long = lambda p: float(np.hypot(*np.diff(p, axis=0).T).sum())
    for d, p, q in near:
        a, b = chain[p], chain[q]
        if d >= reach or a is b or a[0][-1] != p or b[0][0] != q or not geometry.may_join(a[1], b[1], labels[p] == 8):
            continue
        la, lb = long(a[1]), long(b[1])
        wide = (a[2] * la + b[2] * lb) / (la + lb) if la + lb else max(a[2], b[2])
        if repair.free_corridor(plane, labels[p], a[1][-1], b[1][0], wide):
            plane[repair.corridor(a[1][-1], b[1][0], wide, plane.shape)] = labels[p]
            both = (a[0] + b[0], warps.smoothed_at(np.concatenate((a[1], b[1])), len(a[1])), wide)
            chain.update(dict.fromkeys(both[0], both))
    return [c for i, c in chain.items() if c[0][0] == i]


@pytest.mark.parametrize("seed", range(6))
def test_joins_by_hand(seed):
    rng = np.random.default_rng(seed)
    plane = rng.choice(13, (40, 40), p=[0.88, *[0.01] * 12]).astype(np.uint8)
    starts = rng.integers(-3, 42, (60, 2)).astype(float)
    labels = rng.choice((7, 8, 9), 60).tolist()
    paths = [np.array((s, s + (rng.integers(0, 8), 0) if k == 8 else s + (0, rng.integers(0, 8))), float) for s, k in zip(starts, labels, strict=True)]
    if seed == 5:
        paths[0] = paths[0] + 5000.0  # far beyond the plane
    thickness = rng.integers(1, 4, 60).astype(float).tolist()
    other = plane.copy()
    want, got = joined_by_hand(paths, labels, thickness, other, 15.0), repair.joined_segments(paths, labels, thickness, plane, 15.0)
    assert [(m, p.tolist(), t) for m, p, t in got] == [(m, p.tolist(), t) for m, p, t in want] and len(want) < 60
    assert (plane == other).all()


@needs_tables
def test_repaired_segments_take_many_pages_at_once(spark):
    text = plan(spark, "repaired_segments")
    assert "CoGroup" not in text and text.count("hashpartitioning") == 2


def merged_by_hand(points, distance, buffer):
    """Rounds over all pairs, with numpy's own medians and covariance."""

    def fitted(p):
        centre = p.mean(0)
        axis = np.linalg.eigh(np.cov((p - centre).T))[1][:, -1] if len(p) > 1 else np.array([1.0, 0.0])
        axis = axis if (axis[0], axis[1]) > (0, 0) or axis[0] > 1e-12 else -axis
        along, across = (p - centre) @ axis, (p - centre) @ np.array([-axis[1], axis[0]])
        edges = np.linspace(along.min(), along.max(), max(3, int(np.ptp(along) / 5)) + 1)
        bins = [q for q in ((along >= a) & (along <= b) for a, b in zip(edges[:-1], edges[1:], strict=True)) if q.any()]
        return np.array([np.median(p[q], 0) for q in bins]), 2 * float(np.median([np.median(np.abs(across[q] - np.median(across[q]))) for q in bins]))

    live = [([i], p, *fitted(p)) for i, p in enumerate(points)]
    while True:
        root = list(range(len(live)))
        for j in range(len(live)):
            for i in range(j):
                a, b = live[i][2], live[j][2]
                if root[i] != root[j] and (a.min(0) <= b.max(0) + buffer).all() and (b.min(0) <= a.max(0) + buffer).all() and repair.path_distance(a, b) <= distance:
                    root = [root[i] if r == root[j] else r for r in root]
        if len(set(root)) == len(root):
            return [(m, path, t) for m, _, path, t in live]
        groups = [[k for k in range(len(root)) if root[k] == r] for r in dict.fromkeys(root)]
        together = [live[g[0]][1] if len(g) == 1 else np.unique(np.concatenate([live[k][1] for k in g]), axis=0) for g in groups]
        live = sorted([(sorted(m for k in g for m in live[k][0]), p, *(live[g[0]][2:] if len(g) == 1 else fitted(p))) for g, p in zip(groups, together, strict=True)], key=lambda s: s[0][0])


@pytest.mark.parametrize("seed", range(6))
def test_parallel_merges_by_hand(spark, seed):
    rng = np.random.default_rng(seed)
    way = [(1.0, 0.0), (0.0, 1.0), (0.5, 0.25)][seed % 3]
    points = [rng.integers(0, 60, 2) + np.arange(n)[:, None] * way for n in rng.integers(1, 12, 40)]
    want, got = merged_by_hand(points, 2.0, 1.0), repair.merged_parallel(points, 2.0, 1.0)
    assert [(m, p.tolist(), t) for m, p, t in got] == [(m, p.tolist(), t) for m, p, t in want] and len(want) < 40
    df = spark.createDataFrame([(5, 8, i, [(float(x), float(y)) for x, y in p]) for i, p in enumerate(points)], "page long, label int, id long, points array<struct<x: double, y: double>>")
    rows = sorted((r["id"], r["members"], [tuple(q) for q in r["path"]], r["thickness"]) for r in repair.parallel_merges(df, 2.0, 1.0).collect())
    assert rows == [(m[0], m, [tuple(q) for q in p.tolist()], t) for m, p, t in want]


@needs_tables
def test_parallel_merges_take_many_pages_at_once(spark):
    text = plan(spark, "parallel_merges")
    assert "FlatMapGroups" not in text and text.count("hashpartitioning") == 1


@pytest.mark.parametrize("seed", range(4))
def test_bits_are_moved_masks(seed):
    """Dilation, erosion and closing against moved views of the mask."""
    rng = np.random.default_rng(seed)
    mask, kernel = rng.random((13, 17 + seed)) < 0.3, growth.ellipse(*[(8, 3), (7, 5), (10, 3), (1, 1)][seed])

    def moved(m, beyond):
        padded = np.pad(m, 12, constant_values=beyond)
        return [padded[12 + dy : 12 + dy + m.shape[0], 12 + dx : 12 + dx + m.shape[1]] for dy, dx in kernel]

    wide = np.logical_or.reduce(moved(mask, False))
    assert (growth.spread_by(mask, kernel) == wide).all() and (growth.spread_by(mask, kernel, 2) == np.logical_or.reduce(moved(wide, False))).all()
    assert (growth.shrunk_by(mask, kernel) == np.logical_and.reduce(moved(mask, True))).all()
    assert (growth.closed_by(mask, kernel) == np.logical_and.reduce(moved(wide, True))).all()


def test_painted_boxes_are_their_cells(spark):
    rows = [(p, i, 1 + i % 5, (i * 7 + p) % 40 - 4, (i * 11) % 40 - 4, i % 9 + 1, i % 7 + 1) for p in range(3) for i in range(30)]
    boxes = spark.createDataFrame(rows, "page long, id long, label int, x int, y int, w int, h int")
    plane = {}
    for p, _, label, x, y, w, h in rows:
        plane.update({(p, b, a): label for a in range(x, x + w) for b in range(y, y + h) if 0 <= a < 38 and 0 <= b < 36})
    assert sorted(map(tuple, planes.unpacked(planes.painted(boxes, 36, 38)).collect())) == sorted((*k, v) for k, v in plane.items())


@needs_tables
@pytest.mark.parametrize("name", ["text_polygons", "table_polygons"])
def test_painted_pages_shuffle_no_cells(spark, name):
    text = plan(spark, name)
    assert "CoGroup" not in text and "Generate" not in text


def test_hulls_of_columns_of_points():
    rng = np.random.default_rng(1)
    for _ in range(50):
        pts = rng.integers(0, 6, (25, 2)).astype(float)
        ring = geometry.hull_of(pts)
        side = np.roll(ring, -1, 0) - ring
        over = side[:, 0] * (pts[:, 1, None] - ring[:, 1]) - side[:, 1] * (pts[:, 0, None] - ring[:, 0])
        assert (over >= 0).all() and {tuple(p) for p in ring.tolist()} <= {tuple(p) for p in pts.tolist()}
        ahead = np.roll(side, -1, 0)
        assert (side[:, 0] * ahead[:, 1] - side[:, 1] * ahead[:, 0] > 0).all()


@pytest.mark.parametrize("seed", range(6))
def test_windings_and_holes_by_cells(seed):
    """Many overlapping boxes, more than are tested at once, against their cells."""
    rng = np.random.default_rng(seed)
    masks, rings = np.zeros((2, 40, 40), bool), ([], [])
    for k in (0, 1):
        for x, y, w, h in zip(*rng.integers(0, 30, (2, 60)), *rng.integers(1, 9, (2, 60)), strict=True):
            masks[k, y : y + h, x : x + w] = True
            rings[k].append(np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float))
    for name, rule in overlays.RULES.items():
        made = overlays.polygons(overlays.overlay(*rings, rule))
        want = rule(*masks)
        got = np.zeros((40, 40), int)
        centres = np.argwhere(np.ones((40, 40), bool))[:, ::-1] + 0.5
        for outer, holes in made:
            got += (overlays.within(outer, centres) & ~np.logical_or.reduce([overlays.within(h, centres) for h in holes] or [np.zeros(1600, bool)])).reshape(40, 40)
        assert (got == want).all(), name
        assert sum(contours.signed_area(r) for outer, holes in made for r in (outer, *holes)) == want.sum()


@needs_tables
@pytest.mark.parametrize("name", ["polygon_union", "polygon_difference"])
def test_overlays_take_both_sides_as_one_table(spark, name):
    assert "CoGroup" not in plan(spark, name)


def test_straight_paths_equal_fitted_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(1, "HV"[i % 2], i, [float(v) for v in rng.integers(0, 60, 2)], [float(v) for v in rng.integers(0, 60, 2)], 64.0, 50.0) for i in range(60)]
    rows += [(1, "H", 98, [5.0, 5.0], [1.0, 9.0], 64.0, 50.0), (1, "H", 99, None, [1.0, 9.0], 64.0, 50.0), (1, "H", 100, [1.0], [1.0], 64.0, 50.0), (1, "V", 101, [1.0, 2.0, 3.0], [0.0, 5.0, 9.0], 64.0, 50.0), (1, "V", 102, [1.0, 2.0], [0.0, 5.0], None, 50.0), (1, "V", 103, [1.0, 2.0], [0.0, 5.0], float("nan"), 50.0), (1, "V", 104, [], [], 64.0, 50.0)]
    df = spark.createDataFrame(rows, "page long, kind string, id long, x array<double>, y array<double>, width double, height double")
    got = {r["id"]: np.stack((r["x"], r["y"]), 1) for r in curves.cut_paths(df, 7).collect()}
    paths = {i: curves.cut_path(np.stack((x, y), 1), kind == "H", w, h, 7) for _, kind, i, x, y, w, h in rows if x and w == w and w is not None}
    want = {i: p for i, p in paths.items() if p is not None}
    assert set(got) == set(want) and 101 in got and len(want) > 50
    assert all(np.abs(got[i] - want[i]).max() < 1e-9 * max(1, np.abs(want[i]).max()) for i in want)


@needs_tables
def test_straight_paths_are_made_by_spark(spark):
    assert "Union" in plan(spark, "cut_paths")


def test_closing_equals_the_cell_form(spark):
    rng = np.random.default_rng(7)
    cells = [(p, y, x, int(rng.integers(1, 8))) for p in range(3) for y in range(12) for x in range(9) if rng.random() < 0.4]
    df = spark.createDataFrame(cells, "page long, y int, x int, label int")
    want = rasters.closed(df.filter("label between 1 and 5").select("page", "y", "x"), 2, 1)
    got = planes.unpacked(planes.transformed(planes.packed(df, 12, 9), planes.closing(1, 2, (1, 2, 3, 4, 5)))).select("page", "y", "x")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@needs_tables
def test_mask_close_shuffles_cells_once(spark):
    text = plan(spark, "mask_close")
    assert text.count("hashpartitioning") == 1 and "Generate" not in text
