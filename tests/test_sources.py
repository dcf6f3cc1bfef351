"""Readers and sinks on small files."""

import json

from broadsheet.sources import readers, writers
from broadsheet.streaming import monitor
from pyspark.sql import functions as F


def test_run_logs(spark, tmp_path):
    for run, epochs in (("1", 3), ("2", 2)):
        folder = tmp_path / "runs" / run
        folder.mkdir(parents=True)
        (folder / "config.json").write_text(json.dumps({"backbone": "vgg16", "model": "fpn", "labels": "txt", "epochs": 3, "fold": 1, "ngpus": 4} | ({"illustrations": True} if run == "1" else {})))
        (folder / "run.json").write_text(json.dumps({"status": "COMPLETED", "start_time": "2020-01-01T00:00:00", "stop_time": "2020-01-01T01:00:00", "host": {"hostname": "h", "gpus": {"gpus": [{"model": "V100"}]}}}))
        (folder / "metrics.json").write_text(json.dumps({"val_matthews": {"values": [0.1] * epochs}}))
    runs = readers.run_logs(spark, str(tmp_path / "runs"))
    assert {(r["run"], r["labels"], r["gpu"]) for r in runs.collect()} == {("1", "blkx", "V100"), ("2", "blk", "V100")}
    assert readers.metric_rows(runs).count() == 5


def test_folds_csv_and_tex(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"fold-{k}.csv").write_text("metric-type;metric;value;number of samples\nsep;matthews;0.915%d;21\n" % k)
    rows = readers.fold_results(spark, str(tmp_path / "*.csv"))
    assert [(r["fold"], float(r["value"])) for r in rows.orderBy("fold").collect()] == [(1, 0.9151), (2, 0.9152)]
    table = rows.groupBy("mode").pivot("fold", [1, 2, 3]).agg(F.first("value"))
    assert writers.tex_rows(table, "mode", ["1", "2", "3"]).first()[0] == r"sep & 91.51 & 91.52 &  \\"


def test_mets(spark, tmp_path):
    (tmp_path / "e1.xml").write_text('<m:mets xmlns:m="u" xmlns:x="v"><m:fileGrp USE="MAX"><m:file><m:FLocat x:href="a"/></m:file><m:file><m:FLocat x:href="b"/></m:file></m:fileGrp></m:mets>')
    assert readers.editions_xml(spark, str(tmp_path)).first()["urls"] == ["a", "b"]


def test_page_catalog(spark, tmp_path):
    for p in ("1900/2/3/ann/x.psd", "0000/ann/y.psd"):
        (tmp_path / p).parent.mkdir(parents=True)
        (tmp_path / p).write_bytes(b"1")
    rows = readers.page_catalog(spark, str(tmp_path)).collect()
    assert [(r["stem"], r["year"]) for r in rows] == [("y", None), ("x", 1900)]
    assert rows[1]["img_path"].endswith("1900/2/3/img/x.png") and rows[0]["img_path"].endswith("0000/img/y.jpg")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a.png", 1), ("b.png", 2)], "name string, fold int")
    writers.write_folds(rows, "name", str(tmp_path / "folds"))
    assert spark.read.text(str(tmp_path / "folds")).count() == 2
    weights = spark.createDataFrame([(1, 2.0), (0, 1.0)], "idx int, weight double")
    writers.write_weights(weights, str(tmp_path / "w"))
    assert spark.read.text(str(tmp_path / "w")).first()[0] == "[1.0,2.0]"
    metric = spark.sql("select 'r' run, 'm' metric, 1 step, 0.5D value")
    writers.append_metrics(metric, str(tmp_path / "m"))
    writers.append_metrics(metric, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_stream(spark, tmp_path):
    rows = spark.sql("select 'r' run, 'm' metric, 1 step, 0.5D value, timestamp'2024-01-01 00:10:00' ts union all select 'r', 'm', 2, 0.7D, timestamp'2024-01-01 00:20:00'")
    rows.write.parquet(str(tmp_path / "log"))
    stream = monitor.activity(monitor.metric_stream(spark, str(tmp_path / "log")))
    q = stream.writeStream.format("memory").queryName("activity").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [tuple(r)[2:] for r in spark.sql("select * from activity").collect()] == [(2, 0.7, 0.7)]
    assert monitor.silent(rows, F.lit("2024-01-02").cast("timestamp")).count() == 1
