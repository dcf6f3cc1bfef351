"""A stream of metric rows: activity by run and window, and runs that fell silent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC_LOG = "run string, metric string, step int, value double, ts timestamp"


def metric_stream(spark: SparkSession, path: str, schema: str = METRIC_LOG) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def activity(rows: DataFrame, late: str = "12 hours", size: str = "1 hour") -> DataFrame:
    """Rows, best and last value by run and window; rows later than ``late`` are dropped."""
    by = rows.withWatermark("ts", late).groupBy(F.window("ts", size), "run")
    return by.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("best"), F.max_by("value", "ts").alias("last")).select(F.col("window.start").alias("start"), "run", "n", "best", "last")


def silent(rows: DataFrame, now, age: str = "12 hours") -> DataFrame:
    """Runs whose last row is older than ``age`` (batch form of the expiry)."""
    return rows.groupBy("run").agg(F.max("ts").alias("last_seen")).filter(F.col("last_seen") < now - F.expr(f"interval {age}"))
