"""Queries on embeddings take a label whole, however many vectors it has."""

import numpy as np
import pytest
from broadsheet.operators import geometry
from broadsheet.plans import registry

registry.load()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """1,600 vectors of two labels, with numbers up to 8,000, so that vectors of one label lie far apart in the order of numbers."""
    path = tmp_path_factory.mktemp("labels")
    rng = np.random.default_rng(5)
    rows = [(5 * i, [float(np.float32(v)) for v in rng.normal(0, 0.4, 2)], i % 2) for i in range(1600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path), {p: np.array([(i, *e) for i, e, label in rows if label == p]) for p in (0, 1)}


def test_distance_pairs_of_whole_labels(spark, folder):
    path, of = folder
    want = set()
    for page, v in of.items():
        d = np.hypot(v[:, None, 1] - v[None, :, 1], v[:, None, 2] - v[None, :, 2])
        a, b = np.nonzero(np.triu(d < 0.05, 1))
        want |= {(page, int(v[i, 0]), int(v[j, 0])) for i, j in zip(a, b, strict=True)}
    got = [(r.page, r.a, r.b) for r in registry.QUERIES["distance_self_join"](spark, path).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(b - a > 4000 for _, a, b in got)


def test_distance_is_judged_as_it_is_given(spark, tmp_path):
    # 1 and 2 are 0.04999999999 apart, which is given as 0.05 and so isn't below it
    rows = [(1, [0.0, 0.0], 0), (2, [0.04999999999, 0.0], 0), (3, [0.0, 0.01], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [(r.a, r.b, r.d) for r in registry.QUERIES["distance_self_join"](spark, str(tmp_path)).collect()] == [(1, 3, 0.01)]


def test_one_hull_of_each_label(spark, folder):
    path, of = folder
    got = registry.QUERIES["convex_hull"](spark, path).collect()
    assert {r.page for r in got} == {0, 1}
    for page, v in of.items():
        ring = [(r.x, r.y) for r in sorted((r for r in got if r.page == page), key=lambda r: r.corner)]
        assert ring == [tuple(p) for p in geometry.hull_of(v[:, 1:])]


@pytest.mark.parametrize("shape", ["cloud", "grid", "circle", "line", "one"])
def test_hulls_do_not_depend_on_the_shares_of_tasks(spark, shape):
    rng = np.random.default_rng(11)
    turn = np.linspace(0, 2 * np.pi, 300, endpoint=False)
    pts = {"cloud": rng.normal(0, 1, (600, 2)), "grid": rng.integers(0, 9, (600, 2)) * 0.1, "circle": np.stack((np.cos(turn), np.sin(turn)), 1), "line": np.stack((turn, turn), 1), "one": np.ones((7, 2))}[shape]
    rows = [(page, float(x), float(y)) for page in (3, 4) for x, y in pts * page]
    want = {page: [tuple(p) for p in geometry.hull_of(pts * page)] for page in (3, 4)}
    for parts in (1, 7):
        got = geometry.convex_hulls(spark.createDataFrame(rows, "page long, x double, y double").repartition(parts)).collect()
        assert {page: [(r.x, r.y) for r in sorted(got, key=lambda r: r.corner) if r.page == page] for page in want} == want


def test_points_well_inside_never_meet():
    turn = np.linspace(0, 2 * np.pi, 10_000)
    inside = np.stack((np.cos(turn), np.sin(turn)), 1) * 0.6
    corners = np.array([(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)])
    assert len(geometry.outer_points(np.concatenate((inside, corners)))) == 4
