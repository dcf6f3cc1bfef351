"""The driver's tables in the roles that the operators expect, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.planes import by_task

EVENT_CODES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    truth = (F.col("l_linenumber") - 1).cast("int")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("doc"), truth.alias("truth"), F.when(F.col("l_quantity") > 20, truth).otherwise(F.col("l_partkey") % 7).cast("int").alias("pred"))


PAIRS = "pairs AS (SELECT l_orderkey % 50 AS doc, (l_linenumber - 1)::INTEGER AS truth, (CASE WHEN l_quantity > 20 THEN l_linenumber - 1 ELSE l_partkey % 7 END)::INTEGER AS pred FROM lineitem)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    """page, y, x, label from order lines, cells with several labels too."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") % 64).cast("int").alias("y"), (F.col("l_partkey") % 64).cast("int").alias("x"), ((F.col("l_linenumber") * 5 + F.col("l_partkey")) % 13).cast("int").alias("label"))


def plane(spark: SparkSession, d: str) -> DataFrame:
    """``cells`` with one label a cell, the highest."""
    return cells(spark, d).groupBy("page", "y", "x").agg(F.max("label").alias("label"))


PLANE = "plane AS (SELECT l_suppkey AS page, (l_orderkey % 64)::INTEGER AS y, (l_partkey % 64)::INTEGER AS x, max((l_linenumber * 5 + l_partkey) % 13)::INTEGER AS label FROM lineitem GROUP BY ALL)"


def log(spark: SparkSession, d: str) -> DataFrame:
    """run, epoch from 0, metric, value from events."""
    from pyspark.sql import Window

    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("run"), (F.row_number().over(by) - 1).cast("int").alias("epoch"), F.col("event_type").alias("metric"), "value")


LOG = "log AS (SELECT user_id AS run, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS epoch, event_type AS metric, value FROM events)"


def code(column: str):
    return F.create_map(*[F.lit(x) for kv in EVENT_CODES.items() for x in kv])[F.col(column)]


CODE = "CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END"


def spans(spark: SparkSession, d: str) -> DataFrame:
    lo = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("id"), lo.alias("lo"), (lo + F.col("value") * 600).alias("hi"))


SPANS = "spans AS (SELECT user_id AS page, event_id AS id, epoch_us(ts) / 1e6 AS lo, epoch_us(ts) / 1e6 + value * 600 AS hi FROM events)"


def points(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by label: every vector of a label is on its page."""
    return _vectors(spark, d, F.col("label"))


POINTS = "points AS (SELECT label::BIGINT AS page, vec_id AS id, list_extract(embedding, 1)::DOUBLE AS x, list_extract(embedding, 2)::DOUBLE AS y FROM embeddings)"


def point_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by label and stretch of keys, in groups that don't grow with the table."""
    return _vectors(spark, d, F.col("label") * 1_000_000 + F.floor(F.col("vec_id") / 500))


def _vectors(spark: SparkSession, d: str, page: Column) -> DataFrame:
    return table(spark, d, "embeddings").select(page.cast("long").alias("page"), F.col("vec_id").alias("id"), F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))


# a page is a nation and a stretch of keys
_BOXES = {"c": ("customer", "c_custkey", 1500), "s": ("supplier", "s_suppkey", 100)}


def boxes(spark: SparkSession, d: str, table_key: str = "c") -> DataFrame:
    """Boxes on pages of 1000 x 1000, from customers (c), some 60 a page, or suppliers (s), some 4 a page."""
    name, key, held = _BOXES[table_key]
    k = F.col(key)
    b = table(spark, d, name).select((F.col(f"{table_key}_nationkey") + 25 * F.floor(k / held)).cast("long").alias("page"), k.alias("id"), (k * 37 % 1000).cast("double").alias("minx"), (k * 91 % 1000).cast("double").alias("miny"), (k % 23 + 4).cast("double").alias("w"), (k % 17 + 4).cast("double").alias("h"))
    return b.select("page", "id", "minx", "miny", (F.col("minx") + F.col("w")).alias("maxx"), (F.col("miny") + F.col("h")).alias("maxy"))


def boxes_sql(name: str, table_key: str) -> str:
    source, key, held = _BOXES[table_key]
    return f"{name} AS (SELECT ({table_key}_nationkey + 25 * ({key} // {held}))::BIGINT AS page, {key} AS id, ({key} * 37 % 1000)::DOUBLE AS minx, ({key} * 91 % 1000)::DOUBLE AS miny, ({key} * 37 % 1000 + {key} % 23 + 4)::DOUBLE AS maxx, ({key} * 91 % 1000 + {key} % 17 + 4)::DOUBLE AS maxy FROM {source})"


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Short horizontal (8) and vertical (9) segments on the pages of ``plane``; a page's share doesn't grow with the tables. They are shuffled by page once, for what follows too."""
    flat, grown = F.col("l_linenumber") == 6, F.col("l_quantity") % 9 + 3
    x0, y0 = (F.col("l_partkey") % 60).cast("double"), (F.col("l_orderkey") % 60).cast("double")
    x1, y1 = x0 + F.when(flat, grown).otherwise(0.0), y0 + F.when(flat, 0.0).otherwise(grown)
    line = table(spark, d, "lineitem").filter("l_linenumber >= 6")
    return by_task(line.select(F.col("l_suppkey").cast("long").alias("page"), F.when(flat, 8).otherwise(9).alias("label"), _segment_id().alias("id"), x0.alias("x0"), y0.alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), (F.col("l_partkey") % 3 + 1).cast("double").alias("thickness"))).distinct()


def _segment_id():
    """Order, line, part and quantity in one number: order and line alone repeat."""
    return ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")) * 100 + F.col("l_quantity").cast("long")


SEGMENTS = """seg AS (SELECT DISTINCT l_suppkey::BIGINT AS page, CASE WHEN l_linenumber = 6 THEN 8 ELSE 9 END AS label, ((l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey) * 100 + l_quantity::BIGINT AS id, (l_partkey % 60)::DOUBLE AS x0, (l_orderkey % 60)::DOUBLE AS y0,
  (l_partkey % 60 + CASE WHEN l_linenumber = 6 THEN l_quantity % 9 + 3 ELSE 0 END)::DOUBLE AS x1, (l_orderkey % 60 + CASE WHEN l_linenumber = 6 THEN 0 ELSE l_quantity % 9 + 3 END)::DOUBLE AS y1, (l_partkey % 3 + 1)::DOUBLE AS thickness FROM lineitem WHERE l_linenumber >= 6)"""
