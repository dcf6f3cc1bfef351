"""Segmentation quality from pixel pairs (doc, truth, pred).

Everything starts from the confusion table, one partial aggregation over the pixels;
what follows works on documents x classes**2 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio, steady, truncated


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("doc", "truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_sums(cells: DataFrame) -> DataFrame:
    """(doc, class, hit, actual, predicted, within) of classes in truth or prediction; within counts a class's predictions whose truth is predicted somewhere in the document."""
    n, none = F.col("n"), F.lit(0).cast("long")
    seen = F.array_contains(F.collect_set("pred").over(Window.partitionBy("doc")), F.col("truth"))  # as many as there are classes
    one = lambda cls, a, p, hit, within: F.struct(F.col(cls).alias("class"), a.alias("a"), p.alias("p"), hit.alias("hit"), within.alias("within"))
    hit = F.when(F.col("truth") == F.col("pred"), n).otherwise(none)
    sides = cells.withColumn("seen", seen).select("doc", F.explode(F.array(one("truth", n, none, none, none), one("pred", none, n, hit, F.when(F.col("seen"), n).otherwise(none)))).alias("s"))
    return sides.select("doc", "s.*").groupBy("doc", "class").agg(F.sum("hit").alias("hit"), F.sum("a").alias("actual"), F.sum("p").alias("predicted"), F.sum("within").alias("within"))


def _lsd() -> list[Column]:
    """Of the rows of ``class_sums`` of a document; only predicted classes count."""
    hit, predicted = F.col("hit"), F.col("predicted")
    used = lambda x: F.when(predicted > 0, x)
    iu = ratio(hit, predicted + F.col("within") - hit)
    measures = {"pixel_accuracy": F.sum("hit") / F.sum("predicted"), "lsd_mean_accuracy": F.avg(used(ratio(hit, predicted))), "lsd_mean_iu": F.avg(used(iu)), "lsd_fw_iu": F.sum(used(predicted * iu)) / F.sum("predicted")}
    return [steady(x).alias(k) for k, x in measures.items()]


def _averages() -> list[Column]:
    hit, actual, predicted, n = F.col("hit"), F.col("actual"), F.col("predicted"), F.sum("actual")
    each = {"precision": ratio(hit, predicted), "recall": ratio(hit, actual), "jaccard": ratio(hit, actual + predicted - hit)}
    micro = {"precision": F.sum("hit") / n, "recall": F.sum("hit") / n, "jaccard": F.sum("hit") / (2 * n - F.sum("hit"))}
    return [
        *[steady(x).alias(f"{k}_micro") for k, x in micro.items()],
        *[steady(F.avg(x)).alias(f"{k}_macro") for k, x in each.items()],
        *[steady(F.sum(x * actual) / n).alias(f"{k}_weighted") for k, x in each.items()],
    ]


def _matthews() -> list[Column]:
    a, p, n = F.col("actual").cast("double"), F.col("predicted").cast("double"), F.sum("actual").cast("double")
    root = F.sqrt((n * n - F.sum(p * p)) * (n * n - F.sum(a * a)))
    return [steady(ratio(n * F.sum("hit").cast("double") - F.sum(a * p), root)).alias("matthews")]


def lsd_metrics(cells: DataFrame) -> DataFrame:
    """Pixel accuracy and the accuracy and intersection measures over predicted classes.

    The class total is that of the predictions, and the union counts only truth classes
    that are predicted somewhere; published figures rest on both.
    """
    return class_sums(cells).groupBy("doc").agg(*_lsd())


def precision_recall_jaccard(cells: DataFrame) -> DataFrame:
    """Micro, macro and weighted averages; a class without its denominator counts 0."""
    return class_sums(cells).groupBy("doc").agg(*_averages())


def matthews(cells: DataFrame) -> DataFrame:
    """Multi-class Matthews correlation; 0 where a margin holds one class only."""
    return class_sums(cells).groupBy("doc").agg(*_matthews())


def iou(cells: DataFrame) -> DataFrame:
    """Plain mean and frequency-weighted intersection over union, by truth class."""
    j = ratio(F.col("hit"), F.col("actual") + F.col("predicted") - F.col("hit"))
    return class_sums(cells).groupBy("doc").agg(steady(F.avg(j)).alias("iou_mean"), steady(F.sum(j * F.col("actual")) / F.sum("actual")).alias("iou_weighted"))


def all_metrics(cells: DataFrame) -> DataFrame:
    """All measures of a document from one pass over its cells."""
    return class_sums(cells).groupBy("doc").agg(*_lsd(), *_averages(), *_matthews())


def mean_over_documents(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Unweighted mean over documents, cut to four places."""
    return metrics.agg(F.count(F.lit(1)).alias("n_docs"), *[truncated(steady(F.avg(x))).alias(x) for x in names])


def long_form(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return metrics.unpivot(keys, names, "metric", "value")


def pivoted(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One column a metric; a missing cell is null."""
    return rows.groupBy(*keys).pivot("metric", names).agg(F.first("value"))
