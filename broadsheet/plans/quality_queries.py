"""Segmentation quality over order lines in the role of pixel pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from . import roles
from .registry import query

_CELLS = f"{roles.PAIRS}, cells AS (SELECT doc, truth, pred, count(*)::BIGINT AS n FROM pairs GROUP BY ALL)"
_SUMS = """sums AS (SELECT doc, class, sum(hit)::DOUBLE AS hit, sum(a)::DOUBLE AS actual, sum(p)::DOUBLE AS predicted FROM (
  SELECT doc, truth AS class, n AS a, 0 AS p, CASE WHEN truth = pred THEN n ELSE 0 END AS hit FROM cells UNION ALL SELECT doc, pred, 0, n, 0 FROM cells) GROUP BY ALL)"""
_LSD = """lsd AS (SELECT doc, round(sum(hit) / sum(predicted), 9) AS pixel_accuracy, round(avg(hit / predicted), 9) AS lsd_mean_accuracy, round(avg(hit / (predicted + within - hit)), 9) AS lsd_mean_iu,
  round(sum(predicted * (hit / (predicted + within - hit))) / sum(predicted), 9) AS lsd_fw_iu FROM (
  SELECT doc, pred, sum(n)::DOUBLE AS predicted, sum(CASE WHEN truth = pred THEN n ELSE 0 END)::DOUBLE AS hit, sum(CASE WHEN (doc, truth) IN (SELECT (doc, pred) FROM cells) THEN n ELSE 0 END)::DOUBLE AS within FROM cells GROUP BY ALL) GROUP BY doc)"""
_PRJ = """prj AS (SELECT doc, round(sum(hit) / sum(actual), 9) AS precision_micro, round(sum(hit) / sum(actual), 9) AS recall_micro, round(sum(hit) / (2 * sum(actual) - sum(hit)), 9) AS jaccard_micro,
  round(avg(p), 9) AS precision_macro, round(avg(r), 9) AS recall_macro, round(avg(j), 9) AS jaccard_macro,
  round(sum(p * actual) / sum(actual), 9) AS precision_weighted, round(sum(r * actual) / sum(actual), 9) AS recall_weighted, round(sum(j * actual) / sum(actual), 9) AS jaccard_weighted FROM (
  SELECT *, coalesce(hit / nullif(predicted, 0), 0) AS p, coalesce(hit / nullif(actual, 0), 0) AS r, hit / (actual + predicted - hit) AS j FROM sums) GROUP BY doc)"""
_MCC = """mcc AS (SELECT doc, round(coalesce((sum(actual) * sum(hit) - sum(actual * predicted)) / nullif(sqrt((sum(actual) ** 2 - sum(predicted ** 2)) * (sum(actual) ** 2 - sum(actual ** 2))), 0), 0), 9) AS matthews FROM sums GROUP BY doc)"""
NAMES = ["pixel_accuracy", "lsd_mean_accuracy", "lsd_mean_iu", "lsd_fw_iu", "precision_micro", "recall_micro", "jaccard_micro", "precision_macro", "recall_macro", "jaccard_macro", "precision_weighted", "recall_weighted", "jaccard_weighted", "matthews"]


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(roles.pairs(spark, d))


@query(f"WITH {_CELLS} SELECT * FROM cells")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d)


@query(f"WITH {_CELLS}, {_LSD} SELECT * FROM lsd")
def lsd_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.lsd_metrics(_cells(spark, d))


@query(f"WITH {_CELLS}, {_SUMS}, {_PRJ} SELECT * FROM prj")
def prf_micro_macro_weighted(spark: SparkSession, d: str) -> DataFrame:
    return metrics.precision_recall_jaccard(_cells(spark, d))


@query(f"WITH {_CELLS}, {_SUMS}, {_MCC} SELECT * FROM mcc")
def matthews_multiclass(spark: SparkSession, d: str) -> DataFrame:
    return metrics.matthews(_cells(spark, d))


@query(f"WITH {_CELLS}, {_SUMS} SELECT doc, round(avg(hit / (actual + predicted - hit)), 9) AS iou_mean, round(sum(hit / (actual + predicted - hit) * actual) / sum(actual), 9) AS iou_weighted FROM sums GROUP BY doc")
def iou_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.iou(_cells(spark, d))


def _trunc(x: str) -> str:
    return f"sign(round(avg({x}), 9)) * floor(round(abs(round(avg({x}), 9)) * 10000.0, 6)) / 10000.0 AS {x}"


@query(f"WITH {_CELLS}, {_SUMS}, {_LSD}, {_PRJ}, {_MCC} SELECT count(*)::BIGINT AS n_docs, {', '.join(map(_trunc, NAMES))} FROM lsd JOIN prj USING (doc) JOIN mcc USING (doc)")
def metrics_two_level_mean_trunc4(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mean_over_documents(metrics.all_metrics(_cells(spark, d)), NAMES)


@query(f"WITH {_CELLS}, {_SUMS}, {_PRJ}, {_MCC} SELECT doc, precision_macro, recall_macro, matthews FROM prj JOIN mcc USING (doc)")
def metrics_long_to_pivot(spark: SparkSession, d: str) -> DataFrame:
    names = ["precision_macro", "recall_macro", "matthews"]
    cells = _cells(spark, d)
    long = metrics.long_form(metrics.precision_recall_jaccard(cells).join(metrics.matthews(cells), "doc"), ["doc"], names)
    return metrics.pivoted(long, ["doc"], names)


@query("""WITH cells AS (SELECT 0::BIGINT AS doc, quality AS truth, 1 - toxic AS pred, count(*)::BIGINT AS n FROM labels GROUP BY ALL), """ + f"{_SUMS}, {_MCC} SELECT * FROM mcc")
def matthews_two_class(spark: SparkSession, d: str) -> DataFrame:
    rows = roles.table(spark, d, "labels").select(F.lit(0).cast("long").alias("doc"), F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("pred"))
    return metrics.matthews(metrics.confusion(rows))
