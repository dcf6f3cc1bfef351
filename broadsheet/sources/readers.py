"""Readers: run logs, result tables, page images, METS XML, models. Schemas are fixed, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import relabelled

CONFIG = "backbone string, model string, labels string, data_name string, epochs int, fold int, ngpus int, batchsize int, partial double, illustrations boolean"
RUN = "status string, start_time string, stop_time string, host struct<hostname: string, gpus: struct<gpus: array<struct<model: string>>>>"
METRICS = "map<string, struct<values: array<double>>>"
MODEL_META = "classes array<string>, backbone string, full_size array<int>, tile_size array<int>, tile_beta int, type string"


def _whole(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Every file of one name below a folder: its run folder and its text."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("wholetext", True).text(root)
    path = F.col("_metadata.file_path")
    return files.select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("run"), "value")


def run_logs(spark: SparkSession, root: str) -> DataFrame:
    """One row a run folder with config.json, run.json and metrics.json; broken JSON gives nulls in ``status``."""
    part = lambda name, schema, to: _whole(spark, root, name).select("run", F.from_json("value", schema).alias(to))
    runs = part("config.json", CONFIG, "config").join(part("run.json", RUN, "info"), "run").join(part("metrics.json", METRICS, "metrics"), "run", "left")
    return runs.withColumns({"labels": relabelled(F.col("config.labels"), F.col("config.illustrations")), "status": F.col("info.status"), "start": F.to_timestamp("info.start_time"), "stop": F.to_timestamp("info.stop_time"), "n_gpus": F.col("config.ngpus"), "gpu": F.col("info.host.gpus.gpus")[0]["model"]})


def metric_rows(runs: DataFrame) -> DataFrame:
    """(run, metric, epoch, value) from the metric map of run logs."""
    series = runs.select("run", F.explode("metrics").alias("metric", "series"))
    return series.select("run", "metric", F.posexplode("series.values").alias("epoch", "value"))


def fold_results(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon tables metric-type;metric;value;number of samples; the fold is in the file's name."""
    rows = spark.read.schema("mode string, metric string, value decimal(10,4), n int").option("sep", ";").option("header", True).csv(path)
    return rows.withColumn("fold", F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.csv$", 1).cast("int"))


def palette(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("r int, g int, b int").option("sep", " ").csv(path)


def image_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("image string, labels string").csv(path)


def page_catalog(spark: SparkSession, root: str, pattern: str = "*.psd") -> DataFrame:
    """Annotated pages corpus/<year>/<month>/<day>/ann/<stem>; dates by folder, others without one; sorted by path for a stable order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    dated = r"/(\d{4})/(\d{1,2})/(\d{1,2})/ann/([^/]+)\.[^./]+$"
    part = lambda n: F.nullif(F.regexp_extract("path", dated, n), F.lit("")).cast("int")
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    day = F.regexp_extract("path", r"^(.*)/ann/[^/]+$", 1)
    return files.select("path", "length", part(1).alias("year"), part(2).alias("month"), part(3).alias("day"), stem.alias("stem"), F.concat_ws("/", day, F.lit("img"), F.concat(stem, F.when(part(1).isNull(), F.lit(".jpg")).otherwise(F.lit(".png")))).alias("img_path")).orderBy("path")


def page_urls(xml: Column, use: str = "MAX") -> Column:
    """Links of one file group of a METS document, in order."""
    return F.xpath(xml, F.lit(f"//*[local-name()='fileGrp'][@USE='{use}']/*[local-name()='file']/*[local-name()='FLocat']/@*[local-name()='href']"))


def editions_xml(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True).text(root)
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.xml$", 1).alias("edition"), page_urls(F.col("value")).alias("urls"))


def model_registry(spark: SparkSession, root: str) -> DataFrame:
    metas = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "meta.json").text(root)
    rows = metas.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/meta\.json$", 1).alias("name"), F.from_json("value", MODEL_META).alias("meta"))
    return rows.filter(F.col("name").rlike("^[a-z0-9/]+$")).select("name", "meta.*")
