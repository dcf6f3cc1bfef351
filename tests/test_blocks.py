"""Text and table polygons on drawn pages."""

import numpy as np
import pytest
from broadsheet.operators import blocks, overlays
from broadsheet.operators.contours import signed_area
from broadsheet.operators.geometry import hull_of
from broadsheet.operators.planes import packed
from pyspark.sql import functions as F


def page(*boxes, shape=(160, 160)):
    out = np.zeros(shape, np.uint8)
    for label, x0, y0, x1, y1 in boxes:
        out[y0:y1, x0:x1] = label
    return out


def total(polygons):
    return sum(signed_area(o) + sum(map(signed_area, h)) for o, h in polygons)


@pytest.mark.parametrize("seed", range(20))
def test_shrunk_hulls_by_depth(seed):
    rng = np.random.default_rng(seed)
    ring = hull_of(rng.uniform(0, 30, (9, 2)))
    inner = blocks.shrunk(ring, 2.0)
    for p in rng.uniform(0, 30, (200, 2)):
        ends = np.roll(ring, -1, 0)
        t = np.clip(((p - ring) * (ends - ring)).sum(1) / ((ends - ring) ** 2).sum(1), 0, 1)
        far = np.hypot(*(p - ring - t[:, None] * (ends - ring)).T).min()
        held = bool(overlays.within(ring, p)[0])
        assert blocks.depth(ring, p) == pytest.approx(far) if held else blocks.depth(ring, p) < 0
        assert (len(inner) > 0 and bool(overlays.within(inner, p)[0])) == (held and far > 2)


def test_region_around_the_head_of_a_separator():
    # the heading hangs together with both columns only after strong growth, and the separator begins between them
    text = page((4, 10, 10, 150, 30), (4, 10, 36, 70, 140), (4, 90, 36, 150, 140), (9, 76, 33, 84, 140))
    ((alone, _),) = blocks.text_polygons_of(text, [])
    assert signed_area(alone) > 135 * 125
    parts = [r for r, _ in blocks.text_polygons_of(text, [np.array([(80.0, 33.0), (80.0, 140.0)])])]
    assert len(parts) == 3
    top, left, right = sorted(parts, key=lambda r: (r[:, 1].min() > 20, r[:, 0].min()))
    assert top[:, 1].max() < 34 and left[:, 0].max() < 76 and right[:, 0].min() > 83
    # one whose centre lies outside the hull parts nothing
    assert len(blocks.text_polygons_of(text, [np.array([(155.0, 33.0), (155.0, 140.0)])])) == 1


def test_sides():
    bar = np.array([(50.0, 20.0), (52.0, 60.0), (54.0, 90.0)])
    squares = [np.array([(0, 0), (9, 0), (9, 9), (0, 9)], float) + p for p in ((40, 2), (10, 40), (20, 70), (60, 40), (48, 40))]
    assert [blocks.side_of(s.mean(0), bar) for s in squares] == ["top", "left", "left", "right", "right"]
    assert [len(g) for g in blocks.hull_groups(squares, bar)] == [4, 6, 4]
    assert blocks.hull_groups([], bar) == []
    assert blocks.path_centre(np.array([(0.0, 0.0), (10.0, 0.0), (10.0, 2.0)])).tolist() == [70 / 12, 2 / 12] and blocks.path_centre(np.ones((1, 2))).tolist() == [1, 1]


def test_pictures_are_taken_out():
    plain = page((2, 20, 20, 140, 140))
    holed = page((2, 20, 20, 140, 140), (11, 60, 60, 100, 100))
    ((outer, holes),) = blocks.text_polygons_of(holed, [])
    assert len(holes) == 1 and 40 * 40 <= -signed_area(holes[0]) <= 50 * 46
    assert total(blocks.text_polygons_of(plain, [])) == pytest.approx(signed_area(outer))
    assert blocks.text_polygons_of(np.zeros((50, 50), np.uint8), []) == []


def test_tables_part_at_a_separator():
    table = page((5, 20, 20, 60, 120), (5, 84, 20, 124, 120), (9, 68, 30, 76, 120))
    bar = np.array([(72.0, 30.0), (72.0, 120.0)])
    two = blocks.table_polygons_of(table, [bar])
    assert len(two) == 2 and all(r[:, 0].max() < 68 or r[:, 0].min() >= 76 for r, _ in two)
    assert len(blocks.table_polygons_of(table, [])) == 1
    one = blocks.table_polygons_of(page((5, 20, 20, 70, 120), (5, 76, 20, 140, 120)), [])
    assert len(one) == 1 and total(one) >= 119 * 99
    assert blocks.table_polygons_of(page((5, 20, 20, 24, 24)), []) == []


def test_pages(spark):
    cells = spark.createDataFrame([(1, y, x, 2) for y in range(10, 40) for x in range(10, 60)] + [(2, 1, 1, 0)], "page long, y int, x int, label int")
    planes = packed(cells, 64, 80).withColumn("id", F.lit("clash"))
    lines = spark.createDataFrame([(1, 5, [30.0, 30.0], [1.0, 2.0]), (1, 6, None, None), (3, 1, [1.0], [1.0])], "page long, id long, x array<double>, y array<double>")
    rows = blocks.text_polygons(planes, lines).collect()
    assert [(r["page"], r["id"], r["ring"], r["hole"]) for r in rows] == [(1, 0, 0, False)] and rows[0]["area"] == pytest.approx(30 * 50, rel=0.1)
    assert blocks.table_polygons(planes, lines).count() == 0
    centres = spark.createDataFrame([(1, 1, 1, 5.0, 0.0), (1, 1, 2, 5.0, 1.5), (1, 1, 3, 30.0, 2.0), (1, 2, 4, 0.0, 0.0)], "page long, block long, id long, x double, y double")
    got = blocks.separator_sides(centres, lines.filter("id = 5").withColumnRenamed("id", "block").withColumn("block", F.lit(1).cast("long"))).collect()
    assert sorted((r["id"], r["side"]) for r in got) == [(1, "top"), (2, "left"), (3, "right")]
