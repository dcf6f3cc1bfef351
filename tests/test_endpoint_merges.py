"""Segments are joined only where the join test lets them."""

import numpy as np
from broadsheet.operators import geometry


def test_a_rejected_neighbour_leaves_the_end_to_the_right_one():
    sideways = np.array([(0, 0, 100, 0), (105, 40, 200, 40), (150, 0, 300, 0)], float)
    assert geometry.greedy_endpoint_merges(sideways, 500) == [(0, 2)]
    backward = np.array([(0, 0, 100, 0), (95, 0, 300, 1), (110, 0, 300, 0)], float)
    assert (0, 1) not in geometry.greedy_endpoint_merges(backward, 500)
    upright = sideways[:, [1, 0, 3, 2]]
    assert geometry.greedy_endpoint_merges(upright, 500, horizontal=False) == [(0, 2)]


def test_joined_segments_come_out(spark):
    rows = [(1, "H", 7, 0, 0, 100, 0), (1, "H", 8, 105, 40, 200, 40), (1, "H", 9, 150, 0, 300, 0), (1, "H", 10, 310, 0, 400, 0), (1, "V", 11, 0, 0, 0, 50)]
    df = spark.createDataFrame([(p, n, i, *map(float, r)) for p, n, i, *r in rows], "page long, label string, id long, x0 double, y0 double, x1 double, y1 double")
    got = {r["id"]: (r["label"], r["members"], [(p["x"], p["y"]) for p in r["path"]]) for r in geometry.endpoint_merges(df).collect()}
    assert {i: g[:2] for i, g in got.items()} == {7: ("H", [7, 9, 10]), 8: ("H", [8]), 11: ("V", [11])}
    assert got[7][2][0] == (0, 0) and got[7][2][-1] == (400, 0) and len(got[7][2]) == 6
