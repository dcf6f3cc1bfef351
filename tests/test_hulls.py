import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.operators import geometry, rasters


def _inside(p, ring):
    """By angles between corners, a border counts."""
    a, b = ring, np.roll(ring, -1, 0)
    cross = (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[0] - a[:, 0])
    return bool((cross >= 0).all())


def _side(a, b, c):
    return np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))


def _cross(a, b, c, d):
    return _side(a, b, c) * _side(a, b, d) < 0 and _side(c, d, a) * _side(c, d, b) < 0


def meet_by_force(p, q):
    if any(_inside(x, q) for x in p) or any(_inside(x, p) for x in q):
        return True
    return any(_cross(p[i - 1], p[i], q[j - 1], q[j]) for i in range(len(p)) for j in range(len(q)))


def merged_by_force(hulls):
    left = [([i], h) for i, h in enumerate(hulls)]
    while True:
        hit = next(((i, j) for i in range(len(left)) for j in range(i) if meet_by_force(left[i][1], left[j][1])), None)
        if hit is None:
            return sorted(sorted(m) for m, _ in left)
        (m, p), (n, q) = left.pop(hit[0]), left.pop(hit[1])
        left.append((m + n, geometry.hull_of(np.concatenate((p, q)))))


@pytest.mark.parametrize("seed", range(6))
def test_merged_hulls_by_force(seed):
    rng = np.random.default_rng(seed)
    hulls = [geometry.hull_of(rng.integers(0, 300, 2) + rng.integers(0, 9 + 7 * seed, (7, 2))) for _ in range(40)]
    hulls = [h for h in hulls if len(h) > 2]
    assert sorted(m for m, _ in geometry.merged_hulls_of(hulls)) == merged_by_force(hulls)


def test_hulls_of_few_points():
    point, other, line = np.array([[1.0, 1.0]]), np.array([[1.0, 2.0]]), np.array([[0.0, 0.0], [2.0, 2.0]])
    assert geometry.hulls_meet(point, line) and not geometry.hulls_meet(other, line) and not geometry.hulls_meet(point, other)
    assert not geometry.hulls_meet(line, np.array([[3.0, 3.0], [5.0, 5.0]]))
    assert geometry.merged_hulls_of([]) == []


def test_merge_pulls_in_what_only_the_hull_meets(spark):
    # 1 and 2 meet, and only the hull of both reaches 3; 4 is apart, on another page all stand alone
    corners = {1: [(0, 0), (10, 0), (10, 2), (0, 2)], 2: [(8, 1), (10, 1), (10, 12), (8, 12)], 3: [(4, 4), (6, 4), (6, 6), (4, 6)], 4: [(30, 30), (31, 30), (31, 31)]}
    rows = [(1, i, float(x), float(y)) for i, c in corners.items() for x, y in c] + [(2, 3, 4.0, 4.0), (2, 1, 0.0, 0.0)]
    out = geometry.merged_hulls(spark.createDataFrame(rows, "page long, id long, x double, y double"))
    assert sorted((r.page, r.id, tuple(r.members)) for r in out.collect()) == [(1, 1, (1, 2, 3)), (1, 4, (4,)), (2, 1, (1,)), (2, 3, (3,))]


def test_labels_in_rings_with_no_cells(spark):
    plane = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 1, 6)], "page long, y int, x int, label int")
    rings = spark.createDataFrame([(1, 9, [0.0, 2.0, 0.0], [0.0, 0.0, 2.0]), (1, 8, [0.0], [0.0])], "page long, id long, x array<double>, y array<double>")
    assert [tuple(r) for r in geometry.labels_in_rings(plane, rings).collect()] == [(1, 9, 0, 0, 5)]


def test_one_hot_has_a_background_only_beside_several_classes(spark):
    plane = spark.createDataFrame([(1,), (2,), (None,)], "label int")
    assert [r.mask for r in rasters.one_hot(plane, (0,)).collect()] == [[1.0], [0.0], [None]]
    assert rasters.one_hot(plane, (0, 4)).filter(F.col("label") == 2).first().mask == [0.0, 0.0, 1.0]
