"""Binary planes against the form with a row a cell."""

import numpy as np
from broadsheet.functions import tiling
from broadsheet.operators import geometry, planes, rasters
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

CELLS = "page long, y int, x int, label int"


def some(seed, n=300, size=20):
    rng = np.random.default_rng(seed)
    at = {(int(p), int(y), int(x)) for p, y, x in zip(rng.integers(0, 3, n), rng.integers(0, size, n), rng.integers(0, size, n), strict=True)}
    return [(*a, int(rng.integers(1, 13))) for a in sorted(at)]


def rows(df):
    return sorted(tuple(r) for r in df.select("page", "y", "x").collect())


def test_planes_hold_their_cells(spark):
    cells = some(1)
    df = spark.createDataFrame([*cells, (9, 50, 1, 3)], CELLS)  # one outside
    made = planes.packed(df, 20, 20)
    assert sorted(tuple(r) for r in planes.unpacked(made).collect()) == cells and made.count() == 4
    assert planes.unpacked(made.withColumn("data", F.lit(None).cast("binary"))).count() == 0
    assert planes.unpacked(planes.packed(df.limit(0), 20, 20)).count() == 0


def test_morphology_equals_the_cell_form(spark):
    df = spark.createDataFrame(some(2, 900), CELLS)
    made = planes.packed(df, 20, 20)
    inside = rasters.dilated(df.select("page", "y", "x"), 2, 1).filter("y between 0 and 19 and x between 0 and 19")
    assert rows(planes.unpacked(planes.transformed(made, planes.dilation(1, 2)))) == rows(inside)
    shrunk = rows(planes.unpacked(planes.transformed(made, planes.erosion(0, 1))))
    assert shrunk == rows(rasters.eroded(df.select("page", "y", "x"), 1, 0)) and shrunk


def test_tiles_put_together_are_the_page(spark):
    cells = spark.createDataFrame([(1, y, x, 1 + (y * 7 + x) % 12) for y in range(0, 300, 3) for x in range(0, 260, 5)], CELLS)
    axis = lambda full, tile: [(r["x0"], r["x1"], r["inner0"], r["inner1"]) for r in tiling.with_inner(spark.createDataFrame([(full, tile)], "full int, tile int").withColumn("s", tiling.eval_starts(F.col("full"), F.col("tile"))), "s", []).orderBy("i").collect()]
    made = planes.packed(cells, 300, 260)
    tiles = planes.tiled(made, axis(300, 180), axis(260, 170))
    assert tiles.count() == 4
    assert sorted(map(tuple, planes.unpacked(planes.stitched(tiles)).collect())) == sorted(map(tuple, cells.collect()))


@settings(max_examples=40, deadline=None)
@given(st.sets(st.tuples(st.integers(-3, 12), st.integers(-3, 12)), min_size=1, max_size=60))
def test_components_by_flood(cells):
    cells = sorted(cells)
    got = geometry.parts_of(np.array([c[0] for c in cells]), np.array([c[1] for c in cells]))
    number, left, want = 0, set(cells), {}
    for c in cells:
        if c in left:
            number += 1
            todo = [c]
            left.discard(c)
            while todo:
                y, x = todo.pop()
                want[y, x] = number
                around = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= around
                todo += around
    assert got.tolist() == [want[c] for c in cells]
