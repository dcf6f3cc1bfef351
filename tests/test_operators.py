"""Golden vectors and invariants of the segmentation operators."""

import numpy as np
import pandas as pd
import pytest
from broadsheet.functions import names, numbers, tiling
from broadsheet.operators import datasets, geometry, inference, metrics, rasters, runs, spatial
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

TRUTH, PRED = [0, 0, 0, 1, 1, 2, 2, 2, 2, 3], [0, 0, 1, 1, 1, 2, 2, 0, 1, 2]
GOLDEN = {
    "pixel_accuracy": 0.6, "lsd_mean_accuracy": 0.611111111, "lsd_mean_iu": 0.5, "lsd_fw_iu": 0.483333333, "precision_micro": 0.6, "recall_micro": 0.6, "jaccard_micro": 0.428571429, "precision_macro": 0.458333333,
    "recall_macro": 0.541666667, "jaccard_macro": 0.35, "precision_weighted": 0.566666667, "recall_weighted": 0.6, "jaccard_weighted": 0.41, "matthews": 0.456079662,
}


def cells(spark):
    return metrics.confusion(spark.createDataFrame([(1, t, p) for t, p in zip(TRUTH, PRED, strict=True)], "doc long, truth int, pred int"))


def test_metrics_of_a_toy_confusion(spark):
    row = metrics.all_metrics(cells(spark)).first().asDict()
    assert {k: row[k] for k in GOLDEN} == pytest.approx(GOLDEN, abs=1e-8)
    cut = metrics.mean_over_documents(metrics.all_metrics(cells(spark)), list(GOLDEN)).first().asDict()
    assert cut["lsd_mean_accuracy"] == 0.6111 and cut["jaccard_micro"] == 0.4285 and cut["n_docs"] == 1


def test_truncation(spark):
    got = spark.createDataFrame([(0.87069,), (-0.87069,), (0.8706,), (0.0,)], "x double").select(numbers.truncated(F.col("x"))).collect()
    assert [r[0] for r in got] == [0.8706, -0.8706, 0.8706, 0.0]


TILINGS = {
    (640, 384): ([0, 256], [0, 256], [320]),
    (1280, 512): ([0, 384, 768], [0, 384, 768], [448, 832]),
    (1280, 384): ([0, 299, 598, 896], [0, 299, 597, 896], [341, 640, 939]),
    (896, 256): ([0, 160, 320, 480, 640], [0, 160, 320, 480, 640], [208, 368, 528, 688]),
    (512, 512): ([0], [0], []),
}


def test_tilings(spark):
    df = spark.createDataFrame(list(TILINGS), "full int, tile int")
    f, t = F.col("full"), F.col("tile")
    for r in df.select("full", "tile", tiling.train_starts(f, t).alias("a"), tiling.eval_starts(f, t).alias("b"), tiling.predict_starts(f, t).alias("c")).collect():
        cut, rounded, _ = TILINGS[r["full"], r["tile"]]
        assert (r["a"], r["b"], r["c"]) == (cut, cut, rounded)
    inner = tiling.with_inner(df.withColumn("s", tiling.eval_starts(f, t)), "s", []).toPandas()
    for (full, tile), part in inner.sort_values("i").groupby(["full", "tile"]):
        assert part["inner0"].tolist() == [0, *TILINGS[full, tile][2]]
        assert part["inner1"].tolist() == [*TILINGS[full, tile][2], full]


def test_names(spark):
    row = spark.sql("select date'1872-02-01' d, 'M' p, 'layout_896x1280_T512x768' a, 'layout_896x1280' b").select(
        names.edition_id(F.col("d"), F.col("p"), F.lit(3)), names.layout_part(F.col("a"), 3), names.layout_part(F.col("b"), 3), names.layout_part(F.col("b"), 1)
    ).first()
    assert tuple(row) == ("SNP2436020X-18720201-0-3-0-0", 512, None, 896)


@pytest.mark.parametrize("votes, label", [([2, 2, 1], 2), ([1, 2, 3], 0), ([0, 0, 3], 0), ([3, 3, 3], 3), ([0, 0, 0], 0)])
def test_majority(spark, votes, label):
    df = spark.createDataFrame([(1, v) for v in votes], "p int, label int")
    assert rasters.majority(df, ["p"]).first()["label"] == label


@pytest.mark.parametrize("labels, winner", [((0, 1), 0), ((1, 2), 1), ((0, 7), 7), ((7, 8, 9), 9), ((5, 11), 5)])
def test_resample(spark, labels, winner):
    df = spark.createDataFrame([(1, 0, i, x) for i, x in enumerate(labels)], "page int, y int, x int, label int")
    assert rasters.resampled(df, 4, 4).first()["label"] == winner


def test_class_weights(spark):
    df = spark.createDataFrame([("a", x) for x in (0.0, 10.0, 20.0, 40.0)] + [("b", 0.0), ("b", 0.0), ("c", 10.0), ("c", 20.0)], "cls string, share double")
    assert {r["cls"]: r["weight"] for r in rasters.class_weights(df, 100).collect()} == {"a": 5.0, "b": 0.0, "c": 6.666667}
    w = spark.createDataFrame([("t", 1.0), ("x", 2.0), ("y", 4.0)], "cls string, weight double")
    assert {r["cls"]: r["weight"] for r in rasters.background_weight(w, ["t"]).collect()} == {"t": 1.0, "background": 1.333333}


def test_runs(spark):
    log = spark.createDataFrame([(1, i, v) for i, v in enumerate((0.5, 0.9, 0.9))], "run int, epoch int, value double")
    assert runs.best_epoch(log).first()["epoch"] == 1
    assert runs.complete_runs(log, 4).count() == 0
    assert [r["is_best"] for r in runs.running_best(log).orderBy("epoch").collect()] == [True, True, False]
    s = spark.createDataFrame([("a", 0.90), ("a", 0.92), ("a", 0.97), ("b", 0.9)], "k string, v double")
    assert {r["k"]: (r["mean"], r["err"], r["n"]) for r in runs.mean_and_deviation(s, ["k"], "v").collect()} == {"a": (0.93, 0.04, 3), "b": (0.9, None, 1)}
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate((1, 1, 5, 5, 1))], "b int, i int, label int")
    assert [(r["label"], r["length"]) for r in runs.islands(lines, "b", ["i"], "label").orderBy("island").collect()] == [(1, 2), (5, 2), (1, 1)]


def test_folds_and_samples(spark):
    pages = spark.range(104)
    f = datasets.folds(pages, "id").groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in f] == [21, 21, 21, 21, 20]
    assert [datasets.exact_sample(spark.range(83), "id", p).count() for p in (0.1, 0.5, 0.7, 1.0)] == [8, 41, 58, 83]
    assert datasets.editions(spark, "1872-01-01", "1930-12-31").count() == 43098
    assert datasets.parameter_grid(spark).count() == 540


def test_suffixes(spark):
    images = spark.createDataFrame([(x,) for x in ("a1.png", "WARP-a1.png", "b1.png", "xa1.png", "x")], "name string")
    valid = spark.createDataFrame([("a1.png",)], "suffix string")
    assert {r[0] for r in datasets.with_suffix(images, valid, "name").collect()} == {"a1.png", "WARP-a1.png", "xa1.png"}
    assert datasets.with_suffix(images, valid.limit(0), "name").count() == 0


def test_intervals(spark):
    df = spark.createDataFrame([(1, 1, 10.0, 20.0), (1, 2, 18.0, 40.0), (2, 1, 10.0, 20.0), (2, 2, 15.0, 40.0)], "page int, id int, lo double, hi double")
    assert {(r["page"], r["id"], r["other"]) for r in spatial.interval_pairs(df, 7.0).collect()} == {(2, 1, 2), (2, 2, 1)}


def test_geometry():
    ring = geometry.hull_of(np.array([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (0, 0)]))
    assert geometry.area_of(ring) == 16 and len(ring) == 4
    assert len(geometry.rasterised(ring)) == 16
    assert geometry.parts_of(np.array([0, 1, 5]), np.array([0, 1, 5])).tolist() == [1, 1, 2]
    assert geometry.merged_boxes(np.array([(0, 0, 2, 2), (1, 1, 3, 3), (3, 3, 4, 4), (9, 9, 9, 9)])).tolist() == [[0, 0, 4, 4], [9, 9, 9, 9]]
    assert geometry.greedy_endpoint_merges(np.array([(0, 0, 10, 0), (11, 0, 20, 0), (12, 0, 30, 0)], float), 5) == [(0, 1)]
    paths = geometry.xy_cut(np.array([(0, 0, 10, 1), (6, 3, 9, 9), (0, 3, 4, 9), (0, 11, 10, 12)], float))
    assert sorted(range(4), key=lambda i: paths[i]) == [0, 2, 1, 3]
    path, thickness = geometry.polyline_of(np.array([(x, y) for x in range(40) for y in (0, 1, 2)], float))
    assert len(path) >= 7 and np.allclose(path[:, 1], 1) and thickness == 2


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=1, max_size=30))
def test_hull_of_a_hull_is_itself(points):
    ring = geometry.hull_of(np.array(points))
    assert np.array_equal(np.sort(geometry.hull_of(ring), 0), np.sort(ring, 0))


def test_affine():
    m = [0.5, 0.25, 7.0, -0.25, 0.5, -3.0]
    assert np.allclose(numbers.affine_product(m, numbers.affine_inverse(m)), [1, 0, 0, 0, 1, 0])


def test_inference(spark):
    tiles = spark.createDataFrame(pd.DataFrame({"page": [1], "x0": [0], "y0": [0], "h": [1], "w": [3], "pixels": [bytes([0, 200, 90])]}))
    model = lambda: lambda px: np.stack((px < 100, px >= 100), -1)
    assert inference.predicted(tiles, model).first()["labels"] == bytes([0, 1, 0])
    pairs = spark.createDataFrame(pd.DataFrame({"doc": [1], "truth": [bytes(TRUTH)], "pred": [bytes(PRED)]}))
    assert {tuple(r) for r in inference.tile_confusion(pairs, 4).collect()} == {tuple(r) for r in cells(spark).collect()}


def test_morphology(spark):
    dot = spark.createDataFrame([(1, 5, 5)], "page int, y int, x int")
    assert rasters.dilated(dot, 1, 1).count() == 9
    assert [tuple(r) for r in rasters.closed(dot, 1, 1).collect()] == [(1, 5, 5)]
