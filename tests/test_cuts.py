"""Cuts, rays and consensus lines against plain forms."""

import numpy as np
import pytest
from broadsheet.operators import contours, cuts, rays
from broadsheet.operators.geometry import area_of
from hypothesis import given, settings
from hypothesis import strategies as st

from test_regions import MASKS


def holds(ring, p):
    """Whether a point lies inside, by counting crossings."""
    (ax, ay), (bx, by) = ring.T, np.roll(ring, -1, 0).T
    over = (ay > p[1]) != (by > p[1])
    return bool((over & (p[0] < (bx - ax) * (p[1] - ay) / np.where(by == ay, 1, by - ay) + ax)).sum() % 2)


@settings(max_examples=200, deadline=None)
@given(MASKS, st.tuples(*[st.integers(-2, 11)] * 4))
def test_pieces_add_up_and_keep_their_side(mask, line):
    a, b = np.array(line[:2], float), np.array(line[2:], float)
    v = b - a
    for border in contours.borders(mask):
        ring = border.corners.astype(float)
        if len({tuple(p) for p in ring.tolist()}) < len(ring):
            continue
        pieces = cuts.cut(ring, a, b)
        assert sum(map(area_of, pieces)) == pytest.approx(area_of(ring))
        for p in pieces:
            side = v[0] * (p[:, 1] - a[1]) - v[1] * (p[:, 0] - a[0])
            assert (side >= -1e-6).all() or (side <= 1e-6).all()
        ys, xs = np.mgrid[0:9, 0:9]
        for q in np.stack((xs.ravel() + 0.37, ys.ravel() + 0.41), 1):  # on no side and almost never on the line
            if abs(v[0] * (q[1] - a[1]) - v[1] * (q[0] - a[0])) > 1e-6:
                assert sum(holds(p, q) for p in pieces) == holds(ring, q)


def test_a_comb_falls_into_its_teeth():
    comb = np.array([(0, 0), (1, 0), (1, 4), (2, 4), (2, 0), (3, 0), (3, 4), (4, 4), (4, 0), (5, 0), (5, 5), (0, 5)], float)
    assert sorted(map(area_of, cuts.cut(comb, np.array((0, 2)), np.array((9, 2))))) == [2, 2, 2, 11]
    assert len(cuts.cut(comb, np.array((0, 9)), np.array((9, 9)))) == 1 and len(cuts.cut(comb, np.array((1, 1)), np.array((1, 1)))) == 1


def test_blocks_by_baselines(spark):
    blocks = spark.createDataFrame([(1, 5, [0.0, 10.0, 10.0, 0.0], [0.0, 0.0, 9.0, 9.0]), (1, 6, [0.0, 1.0, 0.0], [0.0, 0.0, 1.0])], "page long, id long, x array<double>, y array<double>")
    lines = spark.createDataFrame([(1, 5, 2, 0.0, 6.0, 10.0, 6.0), (1, 5, 1, 0.0, 2.0, 10.0, 2.0), (2, 5, 1, 0.0, 2.0, 10.0, 2.0)], "page long, block long, line long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r["id"], r["piece"], r["area"]) for r in cuts.block_lines(blocks, lines).collect())
    assert got == [(5, 0, 20.0), (5, 1, 40.0), (5, 2, 30.0), (6, 0, 0.5)]


def test_rays_stop_at_the_nearest(spark):
    rows = [(1, 1, 0, 0, 10, 0), (1, 2, 13, -5, 13, 5), (1, 3, 12, 1, 12, 5), (1, 4, 14, -5, 14, 5), (2, 5, 3, 3, 3, 3)]
    s = spark.createDataFrame([(p, i, *map(float, r)) for p, i, *r in rows], "page long, id long, x0 double, y0 double, x1 double, y1 double")
    got = {r["id"]: tuple(r)[2:] for r in rays.clipped_rays(s, 0.5).collect()}
    assert got[1] == (-5, 0, 13, 0) and got[5] == (3, 3, 3, 3) and got[2] == (13, -10, 13, 10)


@pytest.mark.parametrize("seed", range(20))
def test_consensus_by_all_pairs(seed):
    rng = np.random.default_rng(seed)
    xs = rng.uniform(0, 80, 18)
    points = np.concatenate((np.stack((xs, 0.3 * xs + 5 + rng.uniform(-0.4, 0.4, 18)), 1), rng.uniform(0, 80, (9, 2))))
    most = 0
    for i in range(len(points)):
        for j in range(i):
            v = points[j] - points[i]
            off = np.abs(v[0] * (points[:, 1] - points[i, 1]) - v[1] * (points[:, 0] - points[i, 0])) / np.hypot(*v)
            most = max(most, int((off < 1).sum()))
    assert rays.consensus(points, "a").sum() == most
    assert rays.consensus_angle(points, "a", orthogonal=True) == pytest.approx(-np.degrees(np.arctan(0.3)), abs=1.5)
    drawn = rays.consensus(np.tile(points, (4, 1)) + rng.uniform(-0.01, 0.01, (108, 2)), "b", trials=800)
    assert drawn.sum() >= 4 * 16  # drawn pairs find the line too
    assert rays.consensus(points[:2], "c") is None and rays.consensus(np.ones((5, 2)), "d").all()
