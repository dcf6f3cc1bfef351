"""Splines, paths across pages and splits along them."""

import numpy as np
import pytest
from broadsheet.operators import curves
from broadsheet.operators.contours import signed_area
from broadsheet.operators.geometry import area_of
from broadsheet.operators.pages import split_frames


@pytest.mark.parametrize("degree", (1, 2))
def test_basis(degree):
    knots = np.array([0.0] * (degree + 1) + [2, 3, 7] + [9.0] * (degree + 1))
    t = np.linspace(-4, 13, 80)
    design = curves._design(knots, degree, t)
    assert np.allclose(design.sum(1), 1)
    # knots' means give back x itself, beyond the ends too
    means = np.array([knots[i + 1 : i + 1 + degree].mean() for i in range(len(knots) - degree - 1)])
    assert np.allclose(design @ means, t)


def test_few_knots_and_the_bound():
    x = np.linspace(0, 100, 40)
    assert len(curves.smoothing_spline(x, 3 + 0.2 * x + 0.01 * x**2, 2, 1.0).weights) == 3
    assert np.allclose(curves.smoothing_spline(x, 3 + 0.2 * x + 0.01 * x**2, 2, 1.0)(np.array([-50.0, 200])), [18, 443])
    for degree in (1, 2):
        for seed in range(8):
            y = 8 * np.sin(x / (9 + seed)) + np.random.default_rng(seed).normal(0, 0.5, 40)
            bound = 40 + np.sqrt(80)
            made = curves.smoothing_spline(x, y, degree, bound)
            assert ((made(x) - y) ** 2).sum() == pytest.approx(bound, rel=1e-3)
    assert np.allclose(curves.smoothing_spline(np.array([1.0, 1, 1]), np.array([1.0, 2, 3]), 2, 1.0)(np.array([5.0])), 2)
    exact = curves.smoothing_spline(np.arange(6.0), np.array([0, 5, -5, 5, -5, 0.0]), 1, 0.0)
    assert np.allclose(exact(np.arange(6.0)), [0, 5, -5, 5, -5, 0])


def test_paths():
    assert np.allclose(curves.cut_path(np.array([(20.0, 5), (40, 6), (60, 7)]), True, 100, 50), np.stack((np.linspace(0, 100, 10), np.linspace(4, 9, 10)), 1))
    down = curves.cut_path(np.array([(30.0, 40), (30, 10)]), False, 100, 50)
    assert np.allclose(down[:, 0], 30) and down[0, 1] == pytest.approx(0) and down[-1, 1] == pytest.approx(50)
    assert curves.cut_path(np.array([(3.0, 3)]), True, 9, 9) is None and curves.cut_path(np.array([(3.0, 3), (3, 8)]), True, 9, 9) is None
    x = np.linspace(0, 600, 61)
    bow = np.stack((x, 80 * np.sin(x * np.pi / 600)), 1)
    longer = curves.longer(bow, 0.2)
    assert longer[0, 0] == pytest.approx(-60) and longer[-1, 0] == pytest.approx(660) and len(longer) == 74
    assert np.abs(curves.curve_of(bow).points(x)[:, 1] - bow[:, 1]).max() < 12


def test_length_within():
    box, hole = np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float), np.array([(4, 4), (4, 6), (6, 6), (6, 4)], float)
    assert curves.length_within([box, hole], np.array([(-5.0, 5), (15, 5)])) == pytest.approx(8)
    assert curves.length_within([box], np.array([(-5.0, 3), (5, 3), (5, 30)])) == pytest.approx(12)


@pytest.mark.parametrize("seed", range(30))
def test_straight_paths_cut_as_lines_do(seed):
    rng = np.random.default_rng(seed)
    frame = np.array([(0, 0), (200, 0), (200, 150), (0, 150)], float)
    corner = rng.uniform(5, 120, (6, 2))
    content = [np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)]) for (x, y), (w, h) in zip(corner, rng.uniform(4, 25, (6, 2)), strict=True)]
    lines = []
    for i in range(6):
        label, at, bend = "HV"[i % 2], rng.uniform(15, 130), rng.uniform(-4, 4)
        low, high = sorted(rng.uniform(5, 145, 2))
        ends = np.array([(low, at), (high + 5, at + bend)])
        lines.append((label, i, ends if label == "H" else ends[:, ::-1]))
    expected = split_frames(frame, content, lines)
    got = curves.split_along(frame, content, [(k, i, p, curves.cut_path(p, k == "H", 200, 150)) for k, i, p in lines])
    assert [p for p, _ in got] == [p for p, _ in expected]
    assert [area_of(r) for _, r in got] == pytest.approx([area_of(r) for _, r in expected], abs=1e-2)


def test_a_curve_goes_around_content():
    x = np.linspace(0, 1000, 101)
    bow = np.stack((x, 500 - 300 * np.sin(x * np.pi / 1000)), 1)
    frame = np.array([(0, 0), (1000, 0), (1000, 800), (0, 800)], float)
    content = [np.array([(450, 270), (550, 270), (550, 480), (450, 480)], float)]
    cut = curves.cut_path(bow, True, 1000, 800, points=40)
    assert not curves._meets(cut, content) and curves._meets(np.array([(0.0, 400), (1000, 400)]), content)
    leaves = curves.split_along(frame, content, [("H", 1, bow, cut)])
    assert [p for p, _ in leaves] == ["/0", "/1"] and sum(signed_area(r) for _, r in leaves) == pytest.approx(800_000, rel=1e-6)
    assert area_of(leaves[0][1]) == pytest.approx(1000 * (500 - 600 / np.pi), abs=12 * 1000)  # bends of under 10 go, and residuals of some 2 stay


def test_pages(spark):
    pages = spark.createDataFrame([(1, 100, 50, "c"), (2, 10, 10, "c"), (3, None, 5, "c")], "page long, width int, height int, id string")
    content = spark.createDataFrame([(1, [5.0, 20.0, 20.0], [5.0, 5.0, 9.0], 1), (1, None, None, 1)], "page long, x array<double>, y array<double>, leaf int")
    seps = spark.createDataFrame([(1, "H", 1, [10.0, 60.0], [20.0, 20.0]), (1, "V", 2, [50.0, 50.0], [30.0, 40.0]), (1, "H", 3, [4.0], [4.0]), (1, "V", 4, None, None), (9, "V", 2, [50.0, 50.0], [30.0, 40.0])], "page long, kind string, id int, x array<double>, y array<double>")
    got = sorted((r["page"], r["leaf"], r["path"], round(area_of(np.stack((r["x"], r["y"]), 1)), 3)) for r in curves.split_pages_along(pages, content, seps).collect())
    assert got == [(1, 1, "/0", 2000.0), (1, 2, "/1/0", 1500.0), (1, 3, "/1/1", 1500.0), (2, 1, "", 100.0)]
