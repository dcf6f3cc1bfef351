"""Layout and line geometry over boxes of customers and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lines, numbers
from ..operators import layout, spatial
from . import roles
from .registry import query

_C = f"WITH {roles.boxes_sql('c', 'c')}"
_CS = f"{_C}, {roles.boxes_sql('s', 's')}"


@query(f"""{_CS}, r AS (SELECT page, id AS "row", minx - 150 AS minx, maxx + 150 AS maxx, miny - 100 AS miny, maxy + 100 AS maxy FROM c),
e AS (SELECT r.page, "row", s.minx AS x FROM r JOIN s ON r.page = s.page AND s.minx > r.minx AND s.minx < r.maxx AND s.miny <= r.maxy AND s.maxy >= r.miny UNION SELECT page, "row", minx FROM r UNION SELECT page, "row", maxx FROM r)
SELECT page, "row", cell, x0, x1 FROM (SELECT page, "row", x AS x0, lead(x) OVER w AS x1, row_number() OVER w ::INTEGER AS cell FROM e WINDOW w AS (PARTITION BY page, "row" ORDER BY x)) WHERE x1 IS NOT NULL""")
def row_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = roles.boxes(spark, d, "c").select("page", F.col("id").alias("row"), (F.col("minx") - 150).alias("minx"), (F.col("maxx") + 150).alias("maxx"), (F.col("miny") - 100).alias("miny"), (F.col("maxy") + 100).alias("maxy"))
    cuts = roles.boxes(spark, d, "s").select("page", "id", F.col("minx").alias("x"), F.col("miny").alias("y0"), F.col("maxy").alias("y1"))
    return layout.row_cells(rows, cuts)


@query(f"""{_C}, w AS (SELECT page, min(minx) FILTER (maxx - minx > 24) AS l, max(maxx) FILTER (maxx - minx > 24) AS r FROM c GROUP BY page)
SELECT page, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM c JOIN w USING (page) WHERE minx >= l AND maxx <= r GROUP BY page""")
def page_frames(spark: SparkSession, d: str) -> DataFrame:
    return layout.frames(roles.boxes(spark, d, "c").withColumn("width", F.lit(240.0)))


@query(f"""{_CS}, l AS (SELECT page, id % 7 AS block, max(maxx - minx) AS width FROM c WHERE id % 7 > 0 GROUP BY ALL), b AS (SELECT DISTINCT page, id % 7 AS block FROM s)
SELECT page, block, coalesce(width, 0) AS width FROM b LEFT JOIN l USING (page, block)""")
def block_widths(spark: SparkSession, d: str) -> DataFrame:
    block = (F.col("id") % 7).alias("block")
    found = roles.boxes(spark, d, "c").filter("id % 7 > 0").select("page", block, (F.col("maxx") - F.col("minx")).alias("length"))
    return layout.block_widths(roles.boxes(spark, d, "s").select("page", block).distinct(), found)


@query(f"""{_C}, m AS (SELECT page, id, (id % 3)::INTEGER AS label, minx, miny, maxx, maxy FROM c),
g AS (SELECT *, sum(ch) OVER (PARTITION BY page ORDER BY id)::BIGINT AS part FROM (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY page ORDER BY id) <> label THEN 1 ELSE 0 END AS ch FROM m))
SELECT page AS block, part, label, count(*)::BIGINT AS n_lines, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, CASE WHEN label = 5 THEN 'table' ELSE 'text' END AS kind FROM g GROUP BY ALL""")
def block_regrouping(spark: SparkSession, d: str) -> DataFrame:
    b = roles.boxes(spark, d, "c").select(F.col("page").alias("block"), F.col("id").alias("i"), (F.col("id") % 3).cast("int").alias("label"), "minx", "miny", "maxx", "maxy")
    return layout.grouped_lines(b)


@query(f"""{_C} SELECT page, id, round(sqrt((maxx - minx) ** 2 + (maxy - miny) ** 2), 6) AS length, round((maxx - minx) / sqrt((maxx - minx) ** 2 + (maxy - miny) ** 2), 6) AS vx, round(-(maxy - miny) / sqrt((maxx - minx) ** 2 + (maxy - miny) ** 2), 6) AS ux,
round(degrees(atan2(maxy - miny, maxx - minx)), 6) AS angle, (minx + maxx) / 2 AS cx, round((minx + maxx) / 2 - sqrt((maxx - minx) ** 2 + (maxy - miny) ** 2) / 2, 6) AS level_x0 FROM c""")
def baseline_properties(spark: SparkSession, d: str) -> DataFrame:
    line = [F.col(c) for c in ("minx", "miny", "maxx", "maxy")]
    r = lambda x: F.round(x, 6)
    return roles.boxes(spark, d, "c").select("page", "id", r(lines.length(*line)).alias("length"), r(lines.direction(*line)[0]).alias("vx"), r(lines.normal(*line)[0]).alias("ux"), r(lines.angle(*line)).alias("angle"), lines.centre(*line)[0].alias("cx"), r(lines.levelled(*line)[0]).alias("level_x0"))


def _join_sql(condition: str) -> str:
    ends = ", ".join(f"{{'d': sqrt((b.x{j} - a.x{i}) ** 2 + (b.y{j} - a.y{i}) ** 2), 'i': {i}, 'j': {j}}}" for i in (0, 1) for j in (0, 1))
    return f"""{_C}, g AS (SELECT page, id, 8 + id % 2 AS label, minx AS x0, miny AS y0, maxx AS x1, maxy AS y1, sqrt((maxx - minx) ** 2 + (maxy - miny) ** 2) AS len FROM c),
p AS (SELECT a, b, least({ends}) AS e FROM g a JOIN g b ON a.page = b.page AND {condition}),
q AS (SELECT a, b, e, CASE WHEN e.j = 0 THEN b.x0 ELSE b.x1 END - CASE WHEN e.i = 0 THEN a.x0 ELSE a.x1 END AS gx, CASE WHEN e.j = 0 THEN b.y0 ELSE b.y1 END - CASE WHEN e.i = 0 THEN a.y0 ELSE a.y1 END AS gy, CASE WHEN a.len > b.len THEN a ELSE b END AS v FROM p),
r AS (SELECT *, CASE WHEN a.label = 8 THEN gx ELSE gy END AS onward FROM q)
SELECT a.page AS page, a.id AS a, b.id AS b, CASE WHEN a.label <> b.label THEN 'label' WHEN a.x0 = b.x0 AND a.y0 = b.y0 OR a.x1 = b.x1 AND a.y1 = b.y1 THEN 'collapse' WHEN (e.i = 1 AND onward < 0) OR (e.i = 0 AND onward > 0) THEN 'direction'
WHEN abs((a.y0 - b.y0) * (v.x1 - v.x0) - (a.x0 - b.x0) * (v.y1 - v.y0)) / v.len > 25 THEN 'distance' WHEN (a.id + b.id) % 5 = 0 THEN 'mask' ELSE 'joined' END AS code FROM r"""


def _join_codes(c: DataFrame, pairs: DataFrame) -> DataFrame:
    """Codes of pairs (page, a, b) of boxes, whose diagonals are the segments."""
    side = lambda n: c.select("page", F.col("id").alias(n), *[F.col(k).alias(f"{n}_{v}") for k, v in (("minx", "x0"), ("miny", "y0"), ("maxx", "x1"), ("maxy", "y1"))], (8 + F.col("id") % 2).alias(f"{n}_label"))
    part = lambda n: {k: F.col(f"{n}_{k}") for k in ("x0", "y0", "x1", "y1", "label")}
    both = pairs.join(side("a"), ["page", "a"]).join(side("b"), ["page", "b"])
    return both.select("page", "a", "b", lines.join_code(part("a"), part("b"), (F.col("a") + F.col("b")) % 5 != 0).alias("code"))


@query(_join_sql("a.id < b.id AND least(sqrt((b.x0 - a.x0) ** 2 + (b.y0 - a.y0) ** 2), sqrt((b.x0 - a.x1) ** 2 + (b.y0 - a.y1) ** 2), sqrt((b.x1 - a.x0) ** 2 + (b.y1 - a.y0) ** 2), sqrt((b.x1 - a.x1) ** 2 + (b.y1 - a.y1) ** 2)) < 100"))
def segment_join_codes(spark: SparkSession, d: str) -> DataFrame:
    """A code for every two segments of a page with any two ends nearer than 100."""
    c = roles.boxes(spark, d, "c")
    ends = c.select("page", F.col("id").alias("segment"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(x).alias("x"), F.col(y).alias("y")) for i, x, y in ((0, "minx", "miny"), (1, "maxx", "maxy"))])).alias("e"))
    near = spatial.near_pairs(ends.select("page", (2 * F.col("segment") + F.col("e.i")).alias("id"), "e.x", "e.y"), 100.0)
    half = lambda n: F.floor(F.col(n) / 2).alias(n)
    return _join_codes(c, near.select("page", half("a"), half("b")).filter("a != b").distinct())


@query(_join_sql("a.id <> b.id AND sqrt((b.x0 - a.x1) * (b.x0 - a.x1) + (b.y0 - a.y1) * (b.y0 - a.y1)) < 500"))
def segment_near_join_codes(spark: SparkSession, d: str) -> DataFrame:
    """A code for every end and start of a page within the reach of a join."""
    c = roles.boxes(spark, d, "c")
    near = spatial.following(c.select("page", F.col("id").alias("a"), F.col("maxx").alias("x"), F.col("maxy").alias("y")), c.select("page", F.col("id").alias("b"), F.col("minx").alias("x"), F.col("miny").alias("y")), 500.0)
    return _join_codes(c, near)


@query("SELECT event_id, round(0.5 * (1 + cos(pi() * (event_id % 50) / 50.0::DOUBLE)), 9) AS eta FROM events")
def cosine_annealing(spark: SparkSession, d: str) -> DataFrame:
    return roles.table(spark, d, "events").select("event_id", F.round(numbers.cosine_annealing(F.col("event_id") % 50, 50), 9).alias("eta"))


@query()
def horizontal_merges(spark: SparkSession, d: str) -> DataFrame:
    b = roles.boxes(spark, d, "c").withColumns({"height": F.col("maxy") - F.col("miny"), "n_lines": F.lit(1)})
    wide = b.withColumn("maxx", F.col("maxx") + 60).select("page", "minx", "miny", "maxx", "maxy", "height", "n_lines")
    return layout.horizontal_merges(wide, roles.boxes(spark, d, "s").select("page", "minx", "miny", "maxx", "maxy"))
