"""Layout rules and raster kernels on small cases."""

import numpy as np
from broadsheet.functions import lines
from broadsheet.operators import layout, warps
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def test_warps_keep_labels_in_place():
    a = np.arange(12).reshape(3, 4)
    assert (warps.affine(a, np.array([[1, 0, 0], [0, 1, 0]]), a.shape) == a).all()
    shifted = warps.affine(a, np.array([[1, 0, 1], [0, 1, 0]]), a.shape, border=-1)
    assert (shifted[:, :3] == a[:, 1:]).all() and (shifted[:, 3] == -1).all()
    m, shape = warps.rotation(a.shape, 90)
    assert shape == (4, 3) and sorted(warps.affine(a, m, shape).ravel()) == list(range(12))
    assert (warps.affine(a, warps.scaling(a.shape, a.shape), a.shape) == a).all()


def test_votes_and_means():
    a = np.array([[1, 1, 0, 7], [1, 2, 7, 0]])
    assert warps.vote(a, (1, 2), np.array([2, 1, 1, 1, 1, 1, 1, 3])).tolist() == [[1, 7]]
    assert warps.mean_resize(np.array([[0, 2, 4, 6]]), (1, 2)).tolist() == [[1, 5]]
    assert np.allclose(warps.mean_resize(np.arange(3.0)[None], (1, 2)), [[1 / 3, 5 / 3]])


def test_sheets_follow_their_name():
    xs, ys = warps.sheet((20, 30), "a")
    assert (ys == warps.sheet((20, 30), "a")[1]).all() and not (ys == warps.sheet((20, 30), "b")[1]).all()
    assert (ys[:, 0] == np.arange(20)).all() and xs.max() == 29


def test_paths():
    path = np.array([(0, 0), (1, 0.1), (2, 0), (3, 5), (4, 0)])
    assert warps.simplified(path, 0.5).tolist() == [[0, 0], [2, 0], [3, 5], [4, 0]]
    assert warps.line_angle(np.array([(0, 0), (1, 1), (2, 2)])) == 45 and warps.line_angle(path[:2]) is None
    assert np.allclose(warps.extended(np.array([(0, 0), (10, 0)]), 0.1), [(-1, 0), (0, 0), (10, 0), (11, 0)])
    flat = np.array([(i, float(i == 6)) for i in range(13)])
    assert np.isclose(warps.smoothed_at(flat, 6)[6, 1], 0.2) and (warps.smoothed_at(flat, 1) == flat).all()
    assert warps.drawn((5, 9), np.array([(2, 2), (6, 2)]), 1).sum() >= 15


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50)), min_size=2, max_size=15), st.floats(0.1, 10))
def test_simplified_paths_keep_their_ends(points, tolerance):
    out = warps.simplified(np.array(points), tolerance)
    assert tuple(out[0]) == points[0] and tuple(out[-1]) == points[-1] and len(out) <= len(points)


def test_horizontal_merges():
    boxes = np.array([(0, 0, 40, 10, 10, 1), (45, 0, 90, 10, 10, 1), (95, 0, 140, 10, 10, 1), (0, 30, 40, 40, 10, 1)], float)
    none = np.zeros((0, 4))
    assert layout.merged_rows(boxes, none).tolist() == [[0, 0, 140, 10, 10, 1], [0, 30, 40, 40, 10, 1]]
    wall = np.array([(92, -5, 93, 50)], float)
    assert layout.merged_rows(boxes, wall)[:, 2].tolist() == [90, 40, 140]
    assert not layout.may_merge(np.array((0, 0, 40, 10, 10, 1)), np.array((45, 0, 90, 20, 20, 1)))


def test_horizontal_merge_rules():
    none = np.zeros((0, 4))
    n_left = lambda boxes, stoppers=none: len(layout.merged_rows(np.array(boxes, float), np.array(stoppers, float)))
    tall = [(0, 0, 100, 60, 60, 1), (110, 0, 210, 60, 60, 1)]
    assert n_left(tall) == 1
    # off the line between the centres at y 30, but inside (20, 20, 190, 40)
    assert n_left(tall, [(50, 35, 60, 38)]) == 2
    assert n_left(tall, [(50, 45, 60, 48)]) == 1
    # a third box inside the merged one
    assert n_left([*tall, (90, 25, 120, 28, 3, 1)]) == 3
    # equal lower edges, centres 5 apart with heights of 8: half of it is 4
    assert n_left([(0, 0, 40, 20, 8, 1), (45, 10, 85, 20, 8, 1)]) == 2
    assert n_left([(0, 0, 40, 20, 8, 2), (45, 10, 85, 20, 8, 1)]) == 1
    # too low to overlap by 3 at both borders
    assert n_left([(0, 0, 40, 4, 4, 1), (45, 0, 85, 4, 4, 1)]) == 2
    # the second sweep joins what the first one's widths left apart
    assert n_left([(0, 0, 8, 10, 10, 1), (11, 0, 31, 10, 10, 1), (32, 0, 52, 10, 10, 1)]) == 1


def test_horizontal_merges_by_page(spark):
    b = spark.createDataFrame([(1, 0.0, 0.0, 40.0, 10.0, 10.0, 1), (1, 45.0, 0.0, 90.0, 10.0, 10.0, 1), (2, 0.0, 0.0, 40.0, 10.0, 10.0, 1)], "page long, minx double, miny double, maxx double, maxy double, height double, n_lines long")
    s = spark.createDataFrame([(3, 0.0, 0.0, 1.0, 1.0)], "page long, minx double, miny double, maxx double, maxy double")
    assert sorted((r["page"], r["maxx"]) for r in layout.horizontal_merges(b, s).collect()) == [(1, 90.0), (2, 40.0)]


def test_join_codes(spark):
    a = (0, 0, 100, 0, 8)
    cases = [
        (a, (110, 1, 200, 1, 8), "joined"),
        (a, (110, 1, 200, 1, 9), "label"),
        (a, (0, 0, 50, 50, 8), "collapse"),
        (a, (50, 50, 100, 0, 8), "collapse"),
        (a, (95, 0, 200, 0, 8), "direction"),  # b starts before a ends
        (a, (-200, 0, -10, 0, 8), "joined"),  # b ends before a starts
        (a, (-200, 0, 5, 0, 8), "direction"),
        (a, (110, 30, 200, 30, 8), "distance"),
        ((0, 0, 0, 100, 9), (1, 110, 1, 200, 9), "joined"),
        ((0, 0, 0, 100, 9), (1, 90, 1, 200, 9), "direction"),
        (a, (101, 20, 300, 20, 8), "joined"),  # across the gap, which unit vectors don't tell
        ((5, 5, 5, 5, 8), (4, 40, 4, 40, 8), "joined"),  # points have no side
    ]
    names = [f"{s}_{k}" for s in "ab" for k in ("x0", "y0", "x1", "y1", "label")]
    df = spark.createDataFrame([tuple(map(float, x + y)) for x, y, _ in cases], ", ".join(f"{n} double" for n in names))
    side = lambda s: {k: F.col(f"{s}_{k}") for k in ("x0", "y0", "x1", "y1", "label")}
    got = [r[0] for r in df.select(lines.join_code(side("a"), side("b"), F.lit(True))).collect()]
    assert got == [c[2] for c in cases]
    assert df.select(lines.join_code(side("a"), side("b"), F.lit(False))).first()[0] == "mask"
    assert df.select(lines.join_code(side("a"), side("b"), F.lit(True), own_lengths=True)).collect()[10][0] == "parallel"


def test_path_length(spark):
    df = spark.sql("select array(named_struct('x', 0D, 'y', 0D), named_struct('x', 3D, 'y', 4D), named_struct('x', 3D, 'y', 5D)) p, array(named_struct('x', 0D, 'y', 0D)) q")
    assert tuple(df.select(lines.path_length(F.col("p")), lines.path_length(F.col("q")), lines.ends(F.col("p"))[1]["y"]).first()) == (6.0, 0.0, 5.0)
