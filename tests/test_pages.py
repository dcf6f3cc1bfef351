"""Page splits, segment filters and result tables on cases worked out by hand."""

import numpy as np
from broadsheet.operators import pages, runs, segments
from hypothesis import given, settings
from hypothesis import strategies as st

PAGE = np.array([[0, 0], [100, 0], [100, 100], [0, 100]], float)


def box(x0, y0, x1, y1):
    return np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)


def line(label, i, x0, y0, x1, y1):
    return label, i, np.array([[x0, y0], [x1, y1]], float)


def spans(leaves):
    return [(p, *r.min(0).round(6).tolist(), *r.max(0).round(6).tolist()) for p, r in leaves]


def test_horizontal_cut_first_then_columns():
    lines = [line("V", 1, 50, 30, 50, 100), line("H", 2, 0, 20, 100, 20)]
    assert spans(pages.split_frames(PAGE, [], lines)) == [("/0", 0, 0, 100, 20), ("/1/0", 0, 20, 50, 100), ("/1/1", 50, 20, 100, 100)]


def test_a_cut_through_content_comes_last():
    content = [box(10, 15, 20, 25)]
    lines = [line("H", 1, 0, 20, 100, 20), line("V", 2, 60, 0, 60, 100)]
    # the vertical line is free of content, so it cuts before the horizontal one, which lies on both sides and goes to the longer part
    assert spans(pages.split_frames(PAGE, content, lines)) == [("/0/0", 0, 0, 60, 20), ("/0/1", 0, 20, 60, 100), ("/1", 60, 0, 100, 100)]


def test_no_cut_outside_the_frame_and_none_without_lines():
    assert spans(pages.split_frames(PAGE, [], [line("H", 1, 0, 200, 100, 200)])) == [("", 0, 0, 100, 100)]
    assert spans(pages.split_frames(PAGE, [], [])) == [("", 0, 0, 100, 100)]


def test_slanted_cut_keeps_the_area():
    leaves = pages.split_frames(PAGE, [box(0, 0, 5, 5)], [line("H", 1, 0, 40, 100, 60)])
    area = lambda r: abs(np.dot(r[:, 0], np.roll(r[:, 1], -1)) - np.dot(r[:, 1], np.roll(r[:, 0], -1))) / 2
    assert [p for p, _ in leaves] == ["/0", "/1"] and np.allclose([area(r) for _, r in leaves], [5000, 5000])
    # a trapezoid of width 100 with sides 40 and 60: its centre lies at 100 / 3 * (40 + 2 * 60) / (40 + 60)
    assert np.isclose(pages.centroid(leaves[0][1])[0], 160 / 3) and np.isclose(pages.length_inside(leaves[0][1], np.array([[0, 10.0], [200, 10]])), 100)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("HV"), *[st.integers(0, 100)] * 4).filter(lambda t: t[1:3] != t[3:]), max_size=6), st.lists(st.tuples(*[st.integers(0, 80)] * 2), max_size=5))
def test_leaves_tile_the_page(cuts, corners):
    lines = [line(t[0], i, *t[1:]) for i, t in enumerate(cuts)]
    leaves = pages.split_frames(PAGE, [box(x, y, x + 9, y + 9) for x, y in corners], lines)
    area = lambda r: abs(np.dot(r[:, 0], np.roll(r[:, 1], -1)) - np.dot(r[:, 1], np.roll(r[:, 0], -1))) / 2
    assert np.isclose(sum(area(r) for _, r in leaves), 10_000) and len({p for p, _ in leaves}) == len(leaves)


def test_page_without_frame_gives_nothing(spark):
    rows = spark.createDataFrame([(1, "frame", 0, 0.0, 0.0, 10.0, 10.0), (1, "H", 1, 0.0, 4.0, 10.0, 4.0), (1, "V", 2, 3.0, 3.0, 3.0, 3.0), (2, "H", 1, 0.0, 4.0, 10.0, 4.0)], "page long, kind string, id long, x0 double, y0 double, x1 double, y1 double")
    assert [(r.page, r.leaf, r.path) for r in pages.split_pages(rows).sort("leaf").collect()] == [(1, 1, "/0"), (1, 2, "/1")]
    assert pages.split_pages(rows.limit(0)).count() == 0


def test_segment_filters(spark):
    rows = spark.createDataFrame([(1, 1, 8, 11.0, 0.05, 0.0, 0.0, 11.0, 0.0), (1, 2, 8, 10.0, 0.05, 0.0, 0.0, 10.0, 0.0), (1, 3, 7, 1.0, 0.1, 0.0, 0.0, 1.0, 0.0), (1, 4, 5, 50.0, 0.01, 0.0, 0.0, 50.0, 0.0), (2, 5, 9, 50.0, None, 20.0, 0.0, 0.0, 20.0)], "page long, id long, label int, length double, error double, x0 double, y0 double, x1 double, y1 double")
    ids = lambda df: sorted(r.id for r in df.collect())
    planes = spark.createDataFrame([(1, 2000, 1000), (2, 10, 10)], "page long, width long, height long")
    assert ids(segments.well_fitted(rows, planes)) == [1, 2, 4]
    assert ids(segments.well_fitted(rows, planes, min_length=0.011)) == [1, 4]
    assert ids(segments.long_enough(rows)) == [1, 3, 5]
    # the slanted line's bounds hold the box (0, 0, 9, 9), its points pass it; it touches (0, 0, 10, 10) at the corner
    region = lambda n: spark.createDataFrame([(2, 0.0, 0.0, n, n)], "page long, minx double, miny double, maxx double, maxy double")
    assert ids(segments.in_region(rows, region(9.0))) == [] and ids(segments.in_region(rows, region(10.0))) == [5]


def test_families_fractions_and_the_tool(spark):
    rows = spark.createDataFrame([("fpn", "resnet34", 1, 0.5), ("fpn", "resnet50", 2, 0.5), ("unet", "vgg16", 3, 0.5), ("unet", "seresnext50", 4, 0.4)], "model string, backbone string, ord long, value double")
    got = {(r.model, r.family): (r.backbone, r.best_of_model, r.best) for r in runs.family_best(rows).collect()}
    assert got == {("fpn", "resnet"): ("resnet50", True, False), ("unet", "vgg16"): ("vgg16", True, True), ("unet", "other"): ("seresnext50", False, False)}
    cells = rows.selectExpr("'sep' as labels", "cast(ord % 2 as int) as tiling", "'x' as backbone", "model", "value")
    tool = spark.createDataFrame([("sep", 0, 0.6)], "labels string, tiling int, value double")
    assert {(r.tiling, r.model, r.top, r.is_best) for r in runs.best_against_tool(cells, tool).collect()} == {(0, "fpn", 0.6, False), (1, "fpn", 0.5, True)}
    parts = spark.createDataFrame([(0, "a", "fpn", "blk", 1, 0.3, 1, 1.0), (0, "a", "fpn", "blk", 1, 0.3, 2, 2.0), (0, "a", "fpn", "blk", 1, 0.35, 3, 3.0), (0, "b", "fpn", "blk", 1, 0.3, 4, 4.0), (0, "a", "fpn", "blk", 2, 0.3, 5, 5.0)], "tiling int, backbone string, model string, labels string, fold int, partial double, ord long, value double")
    assert [tuple(r) for r in runs.by_fraction(parts, ["blk"]).collect()] == [("blk", 0.3, 2.0)]
