"""Sinks: folds, splits, tiles, class files, metric logs and text tables. All overwrite a whole output or append rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tiling import tile_name


def write_folds(rows: DataFrame, name: str, path: str) -> None:
    """One folder fold=<n> of text lines."""
    rows.select(name, "fold").write.mode("overwrite").partitionBy("fold").text(path)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tiles (kind, page, stem, x0, y0, labels) by kind, with the name of each tile."""
    tiles.withColumn("name", tile_name(F.col("stem"), F.col("x0"), F.col("y0"))).write.mode("overwrite").partitionBy("kind").parquet(path)


def write_pairs(rows: DataFrame, path: str) -> None:
    rows.select("image", "labels").write.mode("overwrite").csv(path)


def write_weights(weights: DataFrame, path: str) -> None:
    """Class weights as one JSON array in class order; one row a class."""
    ordered = weights.agg(F.sort_array(F.collect_list(F.struct("idx", "weight"))).alias("w"))
    ordered.select(F.to_json(F.transform("w", lambda x: x["weight"])).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.select("run", "metric", "step", "value").write.mode("append").parquet(path)


def tex_rows(pivoted: DataFrame, first: str, columns: list[str], factor: float = 100.0) -> DataFrame:
    """One LaTeX line a row: values times ``factor`` to two places, an empty cell where there is none."""
    cells = [F.when(F.col(c).isNull(), F.lit("")).otherwise(F.format_string("%.2f", F.col(c).cast("double") * factor)) for c in columns]
    return pivoted.select(F.concat(F.concat_ws(" & ", F.col(first).cast("string"), *cells), F.lit(r" \\")).alias("line"))


def job_script(configs: DataFrame, command: str) -> DataFrame:
    """All configurations as one script, sorted by name."""
    lines = configs.agg(F.sort_array(F.collect_list("name")).alias("names"))
    return lines.select(F.concat_ws("\n", F.lit("#!/bin/bash"), F.array_join(F.transform("names", lambda n: F.concat(F.lit(f"{command} "), n)), "\n")).alias("script"))
