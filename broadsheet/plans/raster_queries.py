"""Label-raster algebra over order lines in the role of label planes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims, tiling
from ..operators import inference, planes, rasters, warps
from . import roles
from .registry import query

_P = f"WITH {roles.PLANE}"
_CLS = "CASE label " + " ".join(f"WHEN {c} THEN {i}" for i, (_, x) in enumerate(dims.CLASSES) for c in x) + " ELSE 0 END"
_WEIGHT = "CASE label " + " ".join(f"WHEN {c} THEN {w}" for c, _, _, w in dims.LABELS) + " END"


@query(f"{_P} SELECT page, ({_CLS})::INTEGER AS cls, count(*)::BIGINT AS n FROM plane GROUP BY ALL")
def label_lut_remap(spark: SparkSession, d: str) -> DataFrame:
    return rasters.remapped(roles.plane(spark, d)).groupBy("page", "cls").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_P} SELECT page, count(*) FILTER (label IN (1, 2, 3, 4, 5))::BIGINT AS text, count(*) FILTER (label NOT IN (0, 7, 8, 9))::BIGINT AS content, count(*) FILTER (label = 8)::BIGINT AS h, count(*) FILTER (label = 9)::BIGINT AS v, count(*) FILTER (label = 7)::BIGINT AS tabcol FROM plane GROUP BY page")
def label_mask_isin(spark: SparkSession, d: str) -> DataFrame:
    p = roles.plane(spark, d)
    text = rasters.masked(p.withColumn("own", F.col("label")), dims.TEXT_LABELS).withColumn("text", F.col("label") > 0).withColumn("label", F.col("own"))
    rest = rasters.without_separators(text)
    return rest.groupBy("page").agg(F.count_if("text").alias("text"), F.count_if(F.col("label") > 0).alias("content"), *[F.count_if(F.col("own") == c).alias(n) for c, n in ((8, "h"), (9, "v"), (7, "tabcol"))])


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return roles.table(spark, d, "part").select(k.alias("id"), (k * 37 % 256).cast("int").alias("r"), (k * 101 % 256).cast("int").alias("g"), (k * 59 % 256).cast("int").alias("b"))


_PALETTE = [(c, rgb) for c, _, rgb, _ in dims.LABELS[:12]]
_PALETTE_SQL = "(VALUES " + ", ".join(f"({c}, {r}, {g}, {b})" for c, (r, g, b) in _PALETTE) + ") pal(code, pr, pg, pb)"


@query(f"""WITH px AS (SELECT p_partkey AS id, (p_partkey * 37 % 256)::INTEGER AS r, (p_partkey * 101 % 256)::INTEGER AS g, (p_partkey * 59 % 256)::INTEGER AS b FROM part)
SELECT id, r, g, b, (CASE WHEN r <> pr AND g <> pg AND b <> pb THEN 0 ELSE code END)::INTEGER AS label, r <> pr AND g <> pg AND b <> pb AS ignored FROM px, {_PALETTE_SQL}
QUALIFY row_number() OVER (PARTITION BY id ORDER BY (r - pr) ** 2 + (g - pg) ** 2 + (b - pb) ** 2, code) = 1""")
def palette_nearest(spark: SparkSession, d: str) -> DataFrame:
    return rasters.nearest_colour(_pixels(spark, d), _PALETTE)


@query(f"{_P} SELECT page, (y // 8)::INTEGER AS ty, (x // 8)::INTEGER AS tx, label FROM plane QUALIFY row_number() OVER (PARTITION BY page, y // 8, x // 8 ORDER BY {_WEIGHT} DESC, label) = 1")
def resample_priority_vote(spark: SparkSession, d: str) -> DataFrame:
    return rasters.resampled(roles.plane(spark, d), 8, 8)


@query(f"{_P} SELECT page, (y // 4)::INTEGER AS ty, (x // 4)::INTEGER AS tx, max((label > 0)::INTEGER) AS fg FROM plane GROUP BY ALL")
def resample_foreground(spark: SparkSession, d: str) -> DataFrame:
    return rasters.any_foreground(roles.plane(spark, d), 4)


@query(f"""WITH v AS (SELECT date_trunc('hour', ts) AS pixel, {roles.CODE} AS label, count(*)::BIGINT AS c FROM events GROUP BY ALL),
t AS (SELECT pixel, max(c) AS top FROM v GROUP BY pixel)
SELECT pixel, (CASE WHEN count(*) > 1 THEN 0 ELSE min(label) END)::INTEGER AS label, max(top)::BIGINT AS votes FROM v JOIN t USING (pixel) WHERE c = top GROUP BY pixel""")
def majority_vote_undecided(spark: SparkSession, d: str) -> DataFrame:
    votes = roles.table(spark, d, "events").select(F.date_trunc("hour", "ts").alias("pixel"), roles.code("event_type").alias("label"))
    return rasters.majority(votes, ["pixel"])


_SHARES = """s AS (SELECT page, cls, round(coalesce(n, 0) / total::DOUBLE, 9) AS share FROM (SELECT o_custkey AS page, count(*) AS total FROM orders GROUP BY 1) CROSS JOIN (VALUES ('F'), ('O'), ('P'), ('X')) c(cls)
  LEFT JOIN (SELECT o_custkey AS page, o_orderstatus AS cls, count(*) AS n FROM orders GROUP BY ALL) USING (page, cls))"""
_WEIGHTS = "w AS (SELECT cls, round(coalesce(100.0 / median(share) FILTER (share > 0), 0), 6) AS weight FROM s GROUP BY cls)"


def _shares(spark: SparkSession, d: str) -> DataFrame:
    return rasters.shares(roles.table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P", "X"]).withColumnRenamed("o_custkey", "page")


@query(f"WITH {_SHARES} SELECT * FROM s")
def zero_filled_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d)


@query(f"WITH {_SHARES}, {_WEIGHTS} SELECT * FROM w")
def median_class_weights(spark: SparkSession, d: str) -> DataFrame:
    return rasters.class_weights(_shares(spark, d), 100)


@query(f"WITH {_SHARES}, {_WEIGHTS} SELECT cls, weight FROM w WHERE cls = 'F' UNION ALL SELECT 'background', round(1 / sum(1 / nullif(weight, 0)), 6) FROM w WHERE cls <> 'F'")
def harmonic_background_weight(spark: SparkSession, d: str) -> DataFrame:
    return rasters.background_weight(rasters.class_weights(_shares(spark, d), 100), ["F"])


_SIZES_SQL = "sizes(f, t) AS (SELECT DISTINCT CASE WHEN p_size % 10 = 0 THEN t ELSE f END, t FROM (SELECT p_size, (32 * (16 + p_size))::INTEGER AS f, (128 * (2 + p_partkey % 3))::INTEGER AS t FROM part))"
_COUNT = {
    "train": "(SELECT min(k) FROM range(2, 200) r(k) WHERE trunc((k * t - f) / (k - 1)::DOUBLE) >= 50)",
    "eval": "(SELECT min(k) FROM range(2, 200) r(k) WHERE k >= ceil(f / t::DOUBLE) AND t - (f - t) / (k - 1)::DOUBLE > 50)",
}
_RAW = {"cut": "i * (t - trunc((n * t - f) / (n - 1)::DOUBLE)::INTEGER)", "round": "round_even(i * t * ((f - t) / ((n - 1) * t)::DOUBLE), 0)::INTEGER"}


def _tiles_sql(count: str, raw: str) -> str:
    return f"""WITH {_SIZES_SQL}, n AS (SELECT f, t, CASE WHEN f = t THEN 1 ELSE {_COUNT[count]} END AS n FROM sizes),
raw AS (SELECT f, t, n, i, CASE WHEN n = 1 THEN 0 ELSE {_RAW[raw]} END AS x FROM (SELECT f, t, n, unnest(range(n)) AS i FROM n)),
s AS (SELECT f, t, n, i, x - greatest(0, x + t - f) AS x0 FROM raw)
SELECT f::INTEGER AS "full", t::INTEGER AS tile, i::INTEGER AS i, x0::INTEGER AS x0, (x0 + t)::INTEGER AS x1, (CASE WHEN i = 0 THEN 0 ELSE (lag(x0) OVER w + t + x0) // 2 END)::INTEGER AS inner0, (CASE WHEN i = n - 1 THEN f ELSE (x0 + t + lead(x0) OVER w) // 2 END)::INTEGER AS inner1 FROM s WINDOW w AS (PARTITION BY f, t ORDER BY i)"""


def _tiles(spark: SparkSession, d: str, starts) -> DataFrame:
    tile = (128 * (2 + F.col("p_partkey") % 3)).cast("int")
    full = F.when(F.col("p_size") % 10 == 0, tile).otherwise(32 * (16 + F.col("p_size"))).cast("int")
    sizes = roles.table(spark, d, "part").select(full.alias("full"), tile.alias("tile")).distinct()
    return tiling.with_inner(sizes.withColumn("starts", starts(F.col("full"), F.col("tile"))), "starts", [])


@query(_tiles_sql("train", "cut"))
def tiling_train(spark: SparkSession, d: str) -> DataFrame:
    return _tiles(spark, d, tiling.train_starts)


@query(_tiles_sql("eval", "cut"))
def tiling_eval_inner(spark: SparkSession, d: str) -> DataFrame:
    return _tiles(spark, d, tiling.eval_starts)


@query(_tiles_sql("eval", "round"))
def tiling_predict_inner(spark: SparkSession, d: str) -> DataFrame:
    return _tiles(spark, d, tiling.predict_starts)


@query("""SELECT i::INTEGER AS i, count(*)::BIGINT AS n, sum(l_quantity)::DOUBLE AS q FROM (SELECT l_partkey % 1280 AS x, l_quantity FROM lineitem) JOIN (VALUES (0, 0, 341), (1, 341, 640), (2, 640, 939), (3, 939, 1280)) t(i, a, b) ON x >= a AND x < b GROUP BY i""")
def stitch_inner_tiles(spark: SparkSession, d: str) -> DataFrame:
    size = spark.createDataFrame([(1280, 384)], "full int, tile int")
    tiles = tiling.with_inner(size.withColumn("starts", tiling.eval_starts(F.col("full"), F.col("tile"))), "starts", [])
    pixels = roles.table(spark, d, "lineitem").select((F.col("l_partkey") % 1280).alias("x"), "l_quantity")
    return rasters.stitched(pixels, tiles.select("i", "inner0", "inner1")).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


@query(f"""{_P}, z AS (SELECT page, y, x, label, 0 AS z FROM plane WHERE label = 5 UNION ALL SELECT page, y, x, label, 1 FROM plane WHERE label BETWEEN 1 AND 4 UNION ALL SELECT page, y, (x + 1) % 64, label, 2 FROM plane WHERE label IN (7, 8, 9))
SELECT page, y, x, label FROM z QUALIFY row_number() OVER (PARTITION BY page, y, x ORDER BY z DESC, label DESC) = 1""")
def layer_overlay(spark: SparkSession, d: str) -> DataFrame:
    p = roles.plane(spark, d)
    separators = p.filter(F.col("label").isin(7, 8, 9)).withColumn("x", (F.col("x") + 1) % 64)
    return rasters.overlaid([p.filter("label = 5"), p.filter("label between 1 and 4"), separators])


@query(f"{_P} SELECT page, y, x FROM plane WHERE label BETWEEN 1 AND 5 AND NOT EXISTS (SELECT 1 FROM plane q WHERE q.page = plane.page AND q.y = plane.y AND (q.x + 1) % 64 = plane.x AND q.label IN (7, 8, 9))")
def set_difference_mask(spark: SparkSession, d: str) -> DataFrame:
    p = roles.plane(spark, d)
    other = p.filter(F.col("label").isin(7, 8, 9)).select("page", "y", ((F.col("x") + 1) % 64).alias("x"))
    return rasters.subtracted(p.filter("label between 1 and 5").select("page", "y", "x"), other)


@query(f"{_P} SELECT DISTINCT page, y + dy AS y, x + dx AS x FROM (SELECT page, y, x FROM plane WHERE label = 9), (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)")
def mask_dilate(spark: SparkSession, d: str) -> DataFrame:
    return rasters.dilated(roles.plane(spark, d).filter("label = 9"), 1, 1)


@query(f"""{_P}, g AS (SELECT DISTINCT page, y + dy AS y, x + dx AS x FROM (SELECT page, y, x FROM plane WHERE label BETWEEN 1 AND 5), (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx))
SELECT page, y, x FROM (SELECT page, y + dy AS y, x + dx AS x FROM g, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)) GROUP BY ALL HAVING count(*) = 9""")
def mask_close(spark: SparkSession, d: str) -> DataFrame:
    """Closing on binary planes: a cell is shuffled once, with its page, and its box not at all."""
    packed = planes.packed(roles.cells(spark, d), 64, 64)
    return planes.unpacked(planes.transformed(packed, planes.closing(1, 1, (1, 2, 3, 4, 5)))).select("page", "y", "x")


@query(f"{_P} SELECT page, label FROM (SELECT page, label, count(*) * (CASE WHEN label = 0 THEN 0 WHEN label IN (1, 3, 5) THEN 2 ELSE 1 END) AS c FROM plane GROUP BY page, label) QUALIFY row_number() OVER (PARTITION BY page ORDER BY c DESC, label) = 1")
def modal_label(spark: SparkSession, d: str) -> DataFrame:
    return rasters.modal(roles.plane(spark, d), "page", ignore=0, double=(1, 3, 5))


_RATIO = "h AS (SELECT page, label, c::BIGINT AS c, round(c / sum(c) OVER (PARTITION BY page)::DOUBLE, 9) AS ratio FROM (SELECT page, label, count(*) AS c FROM plane GROUP BY ALL))"


@query(f"{_P}, {_RATIO} SELECT * FROM h")
def label_histogram_ratio(spark: SparkSession, d: str) -> DataFrame:
    return rasters.label_ratio(roles.plane(spark, d), "page")


@query(f"{_P}, {_RATIO} SELECT page, rest = 0 AND (other = 0 OR mine > other) AS free FROM (SELECT page, coalesce(sum(ratio) FILTER (label NOT IN (0, 6, 9, 4)), 0) AS rest, coalesce(sum(ratio) FILTER (label = 9), 0) AS mine, coalesce(sum(ratio) FILTER (label = 4), 0) AS other FROM (SELECT * FROM h WHERE page % 4 = 0 OR label IN (0, 4, 6, 9)) GROUP BY page)")
def corridor_join_guard(spark: SparkSession, d: str) -> DataFrame:
    h = rasters.label_ratio(roles.plane(spark, d), "page").filter((F.col("page") % 4 == 0) | F.col("label").isin(0, 4, 6, 9))
    return rasters.corridor_free(h, "page", 9)


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS cls FROM embeddings")
def argmax_first(spark: SparkSession, d: str) -> DataFrame:
    return roles.table(spark, d, "embeddings").select("vec_id", inference.first_maximum(F.col("embedding")).alias("cls"))


@query(f"{_P} SELECT page, x AS y, 63 - y AS x, label FROM plane WHERE label <> 0")
def rotate_plane(spark: SparkSession, d: str) -> DataFrame:
    """Pages turned by 90 degrees as binary planes."""

    def turned(plane: np.ndarray) -> np.ndarray:
        matrix, shape = warps.rotation(plane.shape, 90)
        return warps.affine(plane, matrix, shape)

    return planes.unpacked(planes.transformed(planes.packed(roles.plane(spark, d), 64, 64), turned))


@query(f"{_P} SELECT DISTINCT page, (y + dy)::INTEGER AS y, (x + dx)::INTEGER AS x, 1 AS label FROM plane, range(-1, 2) a(dy), range(-2, 3) b(dx) WHERE label IN (7, 8, 9) AND y + dy BETWEEN 0 AND 63 AND x + dx BETWEEN 0 AND 63")
def dilate_plane(spark: SparkSession, d: str) -> DataFrame:
    """Separators grown by a box of 3 x 5, on binary planes."""
    cells = roles.plane(spark, d).filter(F.col("label").isin(7, 8, 9))
    return planes.unpacked(planes.transformed(planes.packed(cells, 64, 64), planes.dilation(1, 2)))


@query(f"""{_P}, f AS (SELECT page, y, x FROM plane WHERE label > 0)
SELECT f.page, f.y, f.x, 1 AS label FROM f JOIN f l ON l.page = f.page AND l.y = f.y AND l.x = f.x - 1 JOIN f r ON r.page = f.page AND r.y = f.y AND r.x = f.x + 1""")
def erode_plane(spark: SparkSession, d: str) -> DataFrame:
    """Cells with foreground on both sides, on binary planes."""
    return planes.unpacked(planes.transformed(planes.packed(roles.plane(spark, d), 64, 64), planes.erosion(0, 1)))


@query(f"{_P} SELECT page, y, x, label FROM plane WHERE label <> 0")
def stitch_page(spark: SparkSession, d: str) -> DataFrame:
    """Pages cut into overlapping tiles on both axes and put together from the tiles' inner parts."""
    rows, columns = [(0, 40, 0, 32), (24, 64, 32, 64)], [(0, 30, 0, 23), (17, 47, 23, 40), (34, 64, 40, 64)]
    return planes.unpacked(planes.stitched(planes.tiled(planes.packed(roles.plane(spark, d), 64, 64), rows, columns)))


@query(f"""WITH {roles.PLANE} SELECT page, y, x, (label = 3)::INTEGER AS m0, (label = 6)::INTEGER AS m1, (label = 9)::INTEGER AS m2, (label NOT IN (3, 6, 9))::INTEGER AS background FROM plane""")
def one_hot_masks(spark: SparkSession, d: str) -> DataFrame:
    hot = rasters.one_hot(roles.plane(spark, d), (2, 5, 8))
    return hot.select("page", "y", "x", *[F.col("mask")[i].cast("int").alias(n) for i, n in enumerate(("m0", "m1", "m2", "background"))])
