"""Experiment logs: best epochs, deviations, best-of tables, runtimes, status, task queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import FAMILIES, literal_map
from ..functions.numbers import steady


def complete_runs(log: DataFrame, epochs: Column | int) -> DataFrame:
    """Runs (run) whose series has as many rows as the configuration says."""
    want = F.lit(epochs) if isinstance(epochs, int) else epochs
    return log.groupBy("run").agg(F.count(F.lit(1)).alias("n_epochs")).filter(F.col("n_epochs") == want)


def best_epoch(log: DataFrame, score: str = "value") -> DataFrame:
    """The row of each run at the first maximum of its score: one partial aggregation, no window."""
    rest = [c for c in log.columns if c not in ("run", "epoch", score)]
    best = F.max_by(F.struct("epoch", score, *rest), F.struct(F.col(score), -F.col("epoch")))
    return log.groupBy("run").agg(best.alias("b")).select("run", "b.*")


def running_best(log: DataFrame) -> DataFrame:
    """Rows that beat every row before them in their run."""
    before = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("is_best", F.coalesce(F.col("value") > F.max("value").over(before), F.lit(True)))


def mean_and_deviation(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, largest distance from it (null for one sample) and n: the extremes give the distance, so no second pass is needed."""
    mean = F.avg(value)
    err = F.greatest(F.max(value) - mean, mean - F.min(value))
    return samples.groupBy(*keys).agg(steady(mean).alias("mean"), steady(F.when(F.count(value) > 1, err)).alias("err"), F.count(value).alias("n"))


def best_pivot(samples: DataFrame, rows: str, columns: str, names: list, prefer: str) -> DataFrame:
    """For each row and column the name of the best model; ``prefer`` wins ties."""
    best = samples.groupBy(rows, columns, "model").agg(F.max("value").alias("value"))
    return best.groupBy(rows).pivot(columns, names).agg(F.max_by("model", F.struct(F.col("value"), (F.col("model") == prefer).cast("int"))))


def last_best(samples: DataFrame, key: str) -> DataFrame:
    """The best sample of each key; among ties the last in order ``ord``."""
    return samples.groupBy(key).agg(F.max_by(F.struct("ord", "value"), F.struct("value", "ord")).alias("b")).select(key, "b.*")


def family_best(samples: DataFrame) -> DataFrame:
    """The best sample of each model and backbone family, from (model, backbone, ord, value).

    ``best_of_model`` and ``best`` mark the best family of its model and of all; a tie goes to the later
    sample, and between families or models to the one that is first seen later.
    """
    family = F.coalesce(literal_map(FAMILIES)[F.col("backbone")], F.lit("other")).alias("family")
    each = samples.groupBy("model", family).agg(F.max_by(F.struct("backbone", "value"), F.struct("value", "ord")).alias("b"), F.min("ord").alias("seen"))
    each = each.select("model", "family", "b.*", "seen")  # a row a model and family
    model, every = Window.partitionBy("model"), Window.partitionBy(F.lit(0))
    top = F.struct("value", "seen") == F.max(F.struct("value", "seen")).over(model)
    each = each.withColumns({"best_of_model": top, "model_seen": F.min("seen").over(model), "model_value": F.max("value").over(model)})
    first = F.struct("model_value", "model_seen") == F.max(F.struct("model_value", "model_seen")).over(every)
    return each.select("model", "family", "backbone", "value", "best_of_model", (F.col("best_of_model") & first).alias("best"))


def best_against_tool(samples: DataFrame, tool: DataFrame, prefer: str = "fpn") -> DataFrame:
    """The better model of each cell (labels, tiling, backbone), and whether no other cell of its tiling nor the tool's result (labels, tiling, value) is better; ``prefer`` wins ties."""
    cell = samples.groupBy("labels", "tiling", "backbone").agg(F.max_by(F.struct("model", "value"), F.struct(F.col("value"), (F.col("model") == prefer).cast("int"))).alias("c"))
    cell = cell.select("labels", "tiling", "backbone", "c.*")
    top = cell.groupBy("labels", "tiling").agg(F.max("value").alias("top")).join(tool.select("labels", "tiling", F.col("value").alias("tool")), ["labels", "tiling"], "left")
    top = top.select("labels", "tiling", F.greatest("top", F.coalesce("tool", F.lit(0.0)), F.lit(0.0)).alias("top"))
    return cell.join(top, ["labels", "tiling"]).select(*cell.columns, "top", (F.col("value") == F.col("top")).alias("is_best"))


def by_fraction(samples: DataFrame, modes: list[str], steps: int = 10) -> DataFrame:
    """(labels, partial, value) at each decimal fraction of the training data, of the first sample's (tiling, backbone, model) at fold 1; of samples with the same configuration the last by ``ord``."""
    config = ["tiling", "backbone", "model"]
    default = samples.agg(F.min_by(F.struct(*config), "ord").alias("d")).select("d.*")
    wanted = [i / steps for i in range(steps + 1)]
    same = samples.filter(F.col("labels").isin(*modes) & (F.col("fold") == 1) & F.col("partial").isin(*wanted)).join(F.broadcast(default), config, "left_semi")  # one row
    return same.groupBy("labels", "partial").agg(F.max_by("value", "ord").alias("value"))


def runtime_by_gpu(runs: DataFrame, key: list[str], order: list[str], backbones: list[str]) -> DataFrame:
    """Card seconds and runs by card model, and the mean card seconds of a run over all cards.

    Of completed runs (status, backbone, gpu, start, stop, n_gpus) with one of the backbones; of runs
    with the same configuration ``key`` the first one in ``order`` counts.
    """
    done = runs.filter((F.col("status") == "COMPLETED") & F.col("backbone").isin(*backbones))
    spent = ((F.unix_timestamp("stop") - F.unix_timestamp("start")) * F.col("n_gpus")).cast("long")
    by_gpu = first_seen(done, key, order).groupBy("gpu").agg(F.sum(spent).alias("gpu_seconds"), F.count(F.lit(1)).alias("n_runs"))
    every = Window.partitionBy(F.lit(0))  # a row a card model
    return by_gpu.withColumn("mean_gpu_seconds", steady(F.sum("gpu_seconds").over(every) / F.sum("n_runs").over(every), 3))


def status(runs: DataFrame, now: Column, max_age: int) -> DataFrame:
    """Running jobs younger than ``max_age`` seconds: seconds an epoch and the seconds left; no epoch done leaves them null."""
    elapsed = (F.unix_timestamp(now) - F.unix_timestamp("start")).cast("long")
    young = runs.withColumn("elapsed", elapsed).filter((F.col("status") == "RUNNING") & (F.col("elapsed") <= max_age))
    each = F.try_divide(F.col("elapsed").cast("double"), F.col("done").cast("double"))
    return young.select("run", "elapsed", "done", steady(each, 3).alias("seconds_per_epoch"), steady((F.col("epochs") - F.col("done")) * each, 3).alias("eta_seconds"))


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an explicit order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def grid_with_counts(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The whole parameter grid with how often each point has run; never is 0."""
    counts = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def next_tasks(tasks: DataFrame, sample_count: int) -> DataFrame:
    """For each card the task with the fewest runs, if it has fewer than wanted; ties by parameters."""
    pick = tasks.groupBy("gpu").agg(F.min(F.struct("n", "params")).alias("t"))
    return pick.filter(F.col("t.n") < sample_count).select("gpu", "t.params", "t.n")


def moving_mean(series: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    """Mean of n rows from each row on, where there are n."""
    ahead = Window.partitionBy(key).orderBy(*order).rowsBetween(0, n - 1)
    full = series.withColumn("mean", steady(F.avg(value).over(ahead))).withColumn("k", F.count(F.lit(1)).over(ahead))
    return full.filter(F.col("k") == n).drop("k")


def islands(series: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """Runs of equal labels: key, island, label, length."""
    by = Window.partitionBy(key).orderBy(*order)
    change = F.coalesce((F.lag(label).over(by) != F.col(label)).cast("int"), F.lit(0))
    marked = series.withColumn("change", change).withColumn("island", F.sum("change").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(key, "island", label).agg(F.count(F.lit(1)).alias("length"))
