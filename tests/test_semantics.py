"""Cases worked out by hand for rules that are easily read another way."""

import math

import pytest
from broadsheet.operators import datasets, rasters, runs, spatial
from pyspark.sql import functions as F


def test_runtimes_count_cards_once_a_configuration(spark):
    rows = [
        (1, "COMPLETED", "r50", "m", "a", "2020-01-01 00:00:00", "2020-01-01 00:01:40", 2),  # 100 s x 2
        (2, "COMPLETED", "r50", "m", "a", "2020-01-01 00:00:00", "2020-01-01 01:00:00", 2),  # the same configuration again
        (3, "RUNNING", "r34", "m", "a", "2020-01-01 00:00:00", "2020-01-01 01:00:00", 1),
        (4, "COMPLETED", "vgg", "m", "a", "2020-01-01 00:00:00", "2020-01-01 01:00:00", 1),  # another backbone
        (5, "COMPLETED", "r34", "m", "b", "2020-01-01 00:00:00", "2020-01-01 00:00:50", 1),
    ]
    df = spark.createDataFrame(rows, "run long, status string, backbone string, model string, gpu string, start string, stop string, n_gpus long")
    df = df.withColumns({"start": F.col("start").cast("timestamp"), "stop": F.col("stop").cast("timestamp")})
    got = sorted(tuple(r) for r in runs.runtime_by_gpu(df, ["model", "backbone"], ["run"], ["r50", "r34"]).collect())
    assert got == [("a", 200, 1, 125.0), ("b", 50, 1, 125.0)]


def test_modal_label_of_background_only(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (2, 0), (2, 7), (3, 4), (3, 4), (3, 5), (4, 6), (4, 3)], "k long, label int")
    assert {r["k"]: r["label"] for r in rasters.modal(df, "k", ignore=0, double=(5,)).collect()} == {1: 0, 2: 7, 3: 4, 4: 3}


@pytest.mark.parametrize(("own", "hist", "free"), [(9, {0: 0.5, 9: 0.3, 4: 0.2}, True), (9, {9: 0.2, 4: 0.2}, False), (9, {9: 0.3, 5: 0.1}, False), (7, {7: 0.3, 5: 0.2}, True), (7, {7: 0.1, 5: 0.2}, False), (8, {8: 0.5, 6: 0.4, 0: 0.1}, True), (8, {8: 0.5, 9: 0.1}, False), (8, {0: 1.0}, True)])
def test_corridors(spark, own, hist, free):
    df = spark.createDataFrame([(1, k, v) for k, v in hist.items()], "k long, label int, ratio double")
    assert rasters.corridor_free(df, "k", own).first()["free"] is free
    assert rasters.corridor_free(df, "k", own, ignore=(4, 5, 9) if own == 8 else (4, 5)).first()["free"] is True


def test_a_span_beside_all_frames_goes_to_the_first(spark):
    spans = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 500.0, 510.0), (1, 3, 18.0, 40.0)], "page long, id long, lo double, hi double")
    frames = spark.createDataFrame([(1, 7, 5.0, 20.0), (1, 9, 19.0, 60.0)], "page long, id long, lo double, hi double")
    assert {r["id"]: (r["frame"], r["overlap"]) for r in spatial.most_overlap(spans, frames, 10.0).collect()} == {1: (7, 5.0), 2: (7, 0.0), 3: (9, 21.0)}


def test_skew(spark):
    rows = [
        (1, 9, 3, 0, 0, 1, 100), (1, 8, 3, 0, 0, 100, 30),  # a vertical line decides, the horizontal one doesn't count
        (2, 8, 3, 0, 0, 100, 1), (2, 8, 2, 0, 0, 100, 50),  # two points don't count
        (3, 7, 3, 0, 0, 100, 10), (3, 8, 3, 0, 0, 100, 0),  # a rotated table leaves nothing
    ]
    df = spark.createDataFrame([(p, t, n, *map(float, x)) for p, t, n, *x in rows], "page long, label int, n_points int, x0 double, y0 double, x1 double, y1 double")
    got = {r["page"]: r["angle"] for r in spatial.weighted_angle(df).collect()}
    tilt = math.degrees(math.atan(0.01))
    assert got[1] == pytest.approx(tilt, abs=1e-6) and got[2] == pytest.approx(-tilt, abs=1e-6) and got[3] is None


def test_batches_by_bucket(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("grp"), (F.col("id") * F.col("id")).alias("o"))
    got = datasets.batches(df, ["o"], 7, rows_per_bucket=50)
    sizes = [r["count"] for r in got.groupBy("grp", "batch").count().collect()]
    assert set(sizes) == {7} and len(sizes) == 47 + 47 + 47
    assert got.groupBy("grp", "batch").agg(F.min("o").alias("a"), F.max("o").alias("b")).selectExpr("grp", "batch", "a", "lead(a) over (partition by grp order by batch) > b as ok").filter("not ok").isEmpty()


def test_medians_by_bucket(spark):
    shares = [("a", x / 100) for x in (0, 10, 20, 40)] + [("b", 0.0)] + [("c", 0.1), ("c", 0.2)] + [("d", 0.3)] * 5
    df = spark.createDataFrame(shares, "cls string, share double")
    assert {r["cls"]: r["weight"] for r in rasters.class_weights(df, 100).collect()} == {"a": 500.0, "b": 0.0, "c": pytest.approx(666.666667), "d": pytest.approx(333.333333)}
