"""Dataset management: calendar, folds, splits, suffix joins, grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.dims import BACKBONES, LAYOUTS, MODELS


def editions(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Every day, morning and evening."""
    days = spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}', interval 1 day)) AS day")
    return days.select("day", F.explode(F.array(F.lit("M"), F.lit("A"))).alias("part"))


def _ranked(rows: DataFrame, key: str, rows_per_prefix: int = 100_000) -> DataFrame:
    """``__rank`` from 0 in the order of the key's md5, and the number of rows ``__n``.

    Counted in two steps, rows by hash prefix and then inside a prefix, so no task
    sorts all rows; the prefix is as long as the number of rows asks for.
    """
    digits = min(6, max(1, math.ceil(math.log(max(1, rows.count() / rows_per_prefix), 16))))
    digest = F.md5(F.col(key).cast("string"))
    marked = rows.withColumns({"__h": digest, "__p": F.substring(digest, 1, digits)})
    sizes = marked.groupBy("__p").count()
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    sizes = sizes.select("__p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"), F.sum("count").over(whole).alias("__n"))
    inside = Window.partitionBy("__p").orderBy("__h", key)
    ranked = marked.withColumn("__r", F.row_number().over(inside)).join(sizes, "__p")
    return ranked.withColumn("__rank", F.col("__before") + F.col("__r") - 1).drop("__h", "__p", "__r", "__before")


def folds(rows: DataFrame, key: str, n: int = 5) -> DataFrame:
    """n folds whose sizes differ by at most one, the first ones larger."""
    rank, small, extra = F.col("__rank"), F.floor(F.col("__n") / n), F.col("__n") % n
    fold = F.when(rank < extra * (small + 1), F.floor(rank / (small + 1))).otherwise(extra + F.floor((rank - extra * (small + 1)) / F.greatest(small, F.lit(1))))
    return _ranked(rows, key).withColumn("fold", (fold + 1).cast("int")).drop("__rank", "__n")


def exact_sample(rows: DataFrame, key: str, fraction: float) -> DataFrame:
    """floor(n * fraction) rows, the first in hash order: exact, unlike a Bernoulli sample."""
    want = F.floor(F.col("__n") * F.lit(fraction) + F.lit(1e-9))
    return _ranked(rows, key).filter(F.col("__rank") < want).drop("__rank", "__n")


def split_of(fold: Column, held: int) -> Column:
    """The validation fold serves as the test fold as well."""
    return F.when(fold == held, F.lit("val")).otherwise(F.lit("train"))


def with_suffix(names_: DataFrame, suffixes: DataFrame, column: str) -> DataFrame:
    """Rows whose name ends in any of the suffixes.

    Suffixes have few lengths, at most as many as the longest has characters: each name is cut to these lengths and joined by equality,
    which shuffles like any equi-join instead of comparing all with all.
    """
    lengths = [r[0] for r in suffixes.select(F.length("suffix")).distinct().sort(F.length("suffix")).collect()]
    if not lengths:
        return names_.filter(F.lit(False))
    ends = F.array_distinct(F.array(*[F.when(F.length(column) >= n, F.right(F.col(column), F.lit(n))) for n in lengths]))
    cut = names_.select(F.col(column).alias("__name"), F.explode(ends).alias("suffix"))
    hit = cut.join(suffixes.select("suffix").distinct(), "suffix", "left_semi").select("__name").distinct()
    return names_.join(hit, F.col(column) == F.col("__name"), "left_semi")


def parameter_grid(spark: SparkSession) -> DataFrame:
    """Backbones x models x layouts x (separators, text, text with illustrations), with card and batch size."""
    axis = lambda name, values: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    modes = F.explode(F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("illustrations")) for a, b in (("sep", False), ("txt", False), ("txt", True))])).alias("m")
    grid = spark.range(1).select(axis("backbone", BACKBONES)).select("*", axis("model", MODELS)).select("*", axis("data_name", LAYOUTS)).select("*", modes).select("backbone", "model", "data_name", "m.*")
    c = F.col
    return grid.withColumns({"gpu": names.task_gpu(c("backbone"), c("model"), c("data_name")), "batchsize": names.patched_batchsize(F.lit(12), c("backbone"), c("model"), c("data_name")), "fold": F.lit(1), "ngpus": F.lit(4)})


def batches(rows: DataFrame, order: list[str], size: int, rows_per_bucket: int = 200_000) -> DataFrame:
    """Batches of ``size`` rows within each group; a rest that fills no batch is dropped.

    The first column of the order is a number: its range is cut into buckets, counts by group and bucket
    say where each bucket starts, and rows are ranked inside a bucket only.
    """
    first = F.col(order[0])
    low, high, total = rows.agg(F.min(first), F.max(first), F.count(F.lit(1))).first()
    width = max(1.0, (high - low + 1) / math.ceil(total / rows_per_bucket)) if total else 1.0
    marked = rows.withColumn("__b", F.floor((first - F.lit(low)) / F.lit(width)))
    sizes = marked.groupBy("grp", "__b").count()
    up = Window.partitionBy("grp").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("grp", "__b", F.coalesce(F.sum("count").over(up), F.lit(0)).alias("__before"), F.sum("count").over(Window.partitionBy("grp")).alias("__n"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("grp", "__b").orderBy(*order)) - 1
    numbered = marked.join(sizes, ["grp", "__b"]).withColumns({"batch": F.floor(place / size).cast("int"), "n_batches": F.floor(F.col("__n") / size).cast("int")})
    return numbered.filter(F.col("batch") < F.col("n_batches")).drop("__b", "__before", "__n")


def random_page(urls: Column, key: Column, seed: str) -> Column:
    """One of the pages of an edition, the same in every run."""
    place = F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 8), 16, 10).cast("long")
    return F.element_at(urls, (F.pmod(place, F.greatest(F.size(urls), F.lit(1)).cast("long")) + 1).cast("int"))


def checked_equal(a: Column, b: Column, what: str) -> Column:
    """True, or an error that names what differs."""
    return F.when(a == b, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), a.cast("string"), F.lit(" and "), b.cast("string"))).cast("boolean"))
