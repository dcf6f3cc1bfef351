"""Overlays of polygons against rasters and plain membership."""

import numpy as np
import pytest
from broadsheet.operators import overlays
from broadsheet.operators.contours import signed_area
from broadsheet.operators.geometry import hull_of

SQUARE = np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float)


def star(rng):
    """A ring around a point that doesn't cross itself, in either direction."""
    n = rng.integers(4, 12)
    angle = (np.arange(n) + rng.uniform(0, 0.9, n)) * 2 * np.pi / n  # no two neighbours half a turn apart
    ring = rng.uniform(3, 17, 2) + rng.uniform(1, 7, (n, 1)) * np.stack((np.cos(angle), np.sin(angle)), 1)
    return ring[:: rng.choice((1, -1))]


def member(rings, points):
    out = np.zeros(len(points), bool)
    for r in rings:
        out |= overlays.within(r, points)
    return out


@pytest.mark.parametrize("seed", range(60))
@pytest.mark.parametrize("how", sorted(overlays.RULES))
def test_membership_and_area(how, seed):
    rng = np.random.default_rng(seed)
    if seed % 3 == 0:  # hulls of whole corners share sides and corners
        make = lambda: hull_of(rng.integers(0, 12, (6, 2)).astype(float))
    else:
        make = lambda: star(rng)
    a, b = ([r for r in (make() for _ in range(rng.integers(0, 9))) if len(r) >= 3] for _ in range(2))
    rings = overlays.overlay([overlays.oriented(r) for r in a], [overlays.oriented(r) for r in b], overlays.RULES[how])
    points = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(-6.0, 26, 0.173) + 0.0137] * 2)], 1)
    inside = sum((overlays.within(r, points).astype(int) * (1 if signed_area(r) > 0 else -1) for r in rings), np.zeros(len(points), int))
    expected = overlays.RULES[how](member(a, points), member(b, points))
    assert set(np.unique(inside)) <= {0, 1}
    assert (inside.astype(bool) != expected).sum() <= 2  # a point within the rounding of a side
    assert sum(map(signed_area, rings)) == pytest.approx(expected.sum() * 0.173**2, abs=0.173 * (4 + sum(np.hypot(*(np.roll(r, -1, 0) - r).T).sum() for r in rings) * 0.2))
    for r in rings:
        assert len({tuple(p) for p in r.tolist()}) == len(r)


@pytest.mark.parametrize("seed", range(40))
def test_cells_add_up(seed):
    rng = np.random.default_rng(seed)
    masks = rng.random((2, 8, 8)) < rng.uniform(0.1, 0.9)
    cells = [[SQUARE + (x, y) for y, x in zip(*np.nonzero(m), strict=True)] for m in masks]
    for how, rule in overlays.RULES.items():
        rings = overlays.overlay(*cells, rule)
        kept = rule(*masks)
        assert sum(map(signed_area, rings)) == kept.sum()
        edge = np.pad(kept, 1).astype(int)
        assert sum(np.hypot(*(np.roll(r, -1, 0) - r).T).sum() for r in rings) == np.abs(np.diff(edge, axis=0)).sum() + np.abs(np.diff(edge, axis=1)).sum(), how
        assert sum(signed_area(o) + sum(map(signed_area, h)) for o, h in overlays.polygons(rings)) == kept.sum()


@pytest.mark.parametrize("seed", range(20))
def test_areas_of_parts_add_up(seed):
    rng = np.random.default_rng(seed)
    a, b = (overlays.united([star(rng) for _ in range(6)]) for _ in range(2))
    area = {how: sum(map(signed_area, overlays.overlay(a, b, rule))) for how, rule in overlays.RULES.items()}
    whole = [sum(map(signed_area, r)) for r in (a, b)]
    assert area["union"] + area["intersection"] == pytest.approx(sum(whole), abs=1e-3)
    assert area["difference"] + area["intersection"] == pytest.approx(whole[0], abs=1e-3)
    assert area["either"] == pytest.approx(area["union"] - area["intersection"], abs=1e-3)


def test_hole_and_touching_corner():
    around, inner = SQUARE * 10, SQUARE * 4 + 3
    rings = overlays.overlay([around], [inner], overlays.RULES["difference"])
    ((outer, holes),) = overlays.polygons(rings)
    assert signed_area(outer) == 100 and [signed_area(h) for h in holes] == [-16]
    assert [signed_area(r) for r in overlays.overlay(rings, [inner], overlays.RULES["union"])] == [100]
    assert sorted(map(len, overlays.united([SQUARE, SQUARE + 1]))) == [4, 4]
    assert overlays.united([]) == [] and overlays.overlay([around], [around], overlays.RULES["difference"]) == []


def test_pages(spark):
    schema = "page long, id long, x array<double>, y array<double>, hole boolean, area string"
    box = lambda p, x, y, n, hole=None: (p, 7, [float(x), x + float(n), x + float(n), float(x)], [float(y), float(y), y + float(n), y + float(n)], hole, "clash")
    a = spark.createDataFrame([box(1, 0, 0, 10), box(1, 2, 2, 4, True), box(1, 0, 0, 10), box(2, 0, 0, 2), (3, 1, None, None, None, "")], schema)
    b = spark.createDataFrame([box(1, 8, 8, 4), box(4, 0, 0, 1), (4, 1, [1.0, 2.0], [1.0, 2.0], None, "")], schema)
    got = sorted((r["page"], r["id"], r["ring"], r["hole"], r["area"]) for r in overlays.overlaid(a, b, "union").collect())
    # twice the same ring winds twice, so the hole doesn't show
    assert got == [(1, 0, 0, False, 112.0), (2, 0, 0, False, 4.0), (4, 0, 0, False, 1.0)]
    one = overlays.overlaid(a.distinct(), b, "difference")
    assert sorted((r["page"], r["ring"], r["area"]) for r in one.collect()) == [(1, 0, 96.0), (1, 1, -16.0), (2, 0, 4.0)]
    again = overlays.overlaid(one, b.filter("false"), "union")
    assert sorted((r["page"], r["ring"], r["area"]) for r in again.collect()) == [(1, 0, 96.0), (1, 1, -16.0), (2, 0, 4.0)]
