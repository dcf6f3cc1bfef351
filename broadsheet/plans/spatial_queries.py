"""Range and spatial joins, and page geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import geometry, pages, segments, spatial
from . import roles
from .registry import query


@query(f"WITH {roles.SPANS} SELECT a.page, a.id, b.id AS other FROM spans a JOIN spans b ON a.page = b.page AND a.id <> b.id AND a.lo < b.hi + 1 - 3 AND b.lo + 3 < a.hi + 1")
def interval_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    return spatial.interval_pairs(roles.spans(spark, d), 3600.0 * 4)


@query(f"WITH {roles.POINTS} SELECT * FROM (SELECT a.page, a.id AS a, b.id AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9) AS d FROM points a JOIN points b ON a.page = b.page AND a.id < b.id) WHERE d < 0.05")
def distance_self_join(spark: SparkSession, d: str) -> DataFrame:
    return spatial.near_pairs(roles.points(spark, d), 0.05).withColumn("d", F.round("d", 9)).filter("d < 0.05")


_BOXES = f"WITH {roles.boxes_sql('c', 'c')}, {roles.boxes_sql('s', 's')}"
_MEET = "c.page = s.page AND c.minx <= s.maxx AND s.minx <= c.maxx AND c.miny <= s.maxy AND s.miny <= c.maxy"


@query(f"{_BOXES} SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE {_MEET})")
def stopper_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return spatial.unstopped(roles.boxes(spark, d, "c"), roles.boxes(spark, d, "s"), 50.0)


@query(f"{_BOXES} SELECT c.page, c.id, s.id AS r_id FROM c JOIN s ON {_MEET}")
def box_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    return spatial.box_pairs(roles.boxes(spark, d, "c"), roles.boxes(spark, d, "s"), 50.0).select("page", "id", "r_id")


@query(f"""{_BOXES} SELECT c.page, c.id, min(s.id) AS box FROM c JOIN (SELECT page, id, minx - 200 + 5 AS minx, miny - 200 + 5 AS miny, maxx + 200 - 5 AS maxx, maxy + 200 - 5 AS maxy FROM s) s
ON c.page = s.page AND c.minx BETWEEN s.minx AND s.maxx AND c.miny BETWEEN s.miny AND s.maxy GROUP BY ALL""")
def containment_first_match(spark: SparkSession, d: str) -> DataFrame:
    dots = roles.boxes(spark, d, "c").select("page", "id", F.col("minx").alias("x"), F.col("miny").alias("y"))
    wide = roles.boxes(spark, d, "s").select("page", "id", *[(F.col(c) + s).alias(c) for c, s in (("minx", -200), ("miny", -200), ("maxx", 200), ("maxy", 200))])
    return spatial.containing(dots, wide, 100.0)


@query(f"""{_BOXES} SELECT page, id, frame, overlap FROM (SELECT c.page, c.id, s.id AS frame, greatest(0, least(c.maxx, s.maxx + 30) - greatest(c.minx, s.minx - 30)) AS overlap FROM c JOIN s ON c.page = s.page)
QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY overlap DESC, frame) = 1""")
def argmax_overlap_assign(spark: SparkSession, d: str) -> DataFrame:
    spans = roles.boxes(spark, d, "c").select("page", "id", F.col("minx").alias("lo"), F.col("maxx").alias("hi"))
    frames = roles.boxes(spark, d, "s").select("page", "id", (F.col("minx") - 30).alias("lo"), (F.col("maxx") + 30).alias("hi"))
    return spatial.most_overlap(spans, frames, 100.0)


@query(f"""{_BOXES}, g AS (SELECT page, 7 + id % 3 AS label, 2 + id % 4 AS n_points, maxx - minx AS dx, maxy - miny AS dy FROM c WHERE page % 5 > 0 OR id % 3 = 1),
p AS (SELECT page, label, n_points, sqrt(dx * dx + dy * dy) AS length, degrees(asin(sin(CASE WHEN abs(dx) > abs(dy) THEN pi() / 2 - atan2(dy, dx) ELSE pi() / 2 + atan2(dy, dx) END - CASE WHEN label = 8 THEN pi() / 2 ELSE 0 END))) AS phi FROM g),
w AS (SELECT *, label <> 8 AS up, n_points >= 3 AND NOT (label = 7 AND abs(phi) > 15) AS good FROM p)
SELECT page, round(CASE WHEN bool_or(up) THEN sum(phi * length) FILTER (up AND good) / sum(length) FILTER (up AND good) ELSE sum(phi * length) FILTER (NOT up AND good) / sum(length) FILTER (NOT up AND good) END, 6) AS angle FROM w GROUP BY page""")
def weighted_mean_angle(spark: SparkSession, d: str) -> DataFrame:
    b = roles.boxes(spark, d, "c").filter((F.col("page") % 5 > 0) | (F.col("id") % 3 == 1))
    return spatial.weighted_angle(b.select("page", (7 + F.col("id") % 3).alias("label"), (2 + F.col("id") % 4).alias("n_points"), F.col("minx").alias("x0"), F.col("miny").alias("y0"), F.col("maxx").alias("x1"), F.col("maxy").alias("y1")))


@query(f"""{_BOXES} SELECT page AS frame, id FROM (SELECT page, id, id % 5 = 0 AS crosses, CASE WHEN id % 2 = 0 THEN 'H' ELSE 'V' END AS label, minx, miny FROM c)
QUALIFY row_number() OVER (PARTITION BY page ORDER BY crosses, label, CASE WHEN label = 'H' THEN miny ELSE minx END, id) = 1""")
def best_split_separator(spark: SparkSession, d: str) -> DataFrame:
    b = roles.boxes(spark, d, "c").select(F.col("page").alias("frame"), "id", (F.col("id") % 5 == 0).alias("crosses"), F.when(F.col("id") % 2 == 0, "H").otherwise("V").alias("label"), F.col("minx").alias("x"), F.col("miny").alias("y"))
    return spatial.split_choice(b)


@query(f"""{_BOXES} SELECT page, id, round(0.5 * minx + 0.25 * miny + 7, 6) AS x, round(-0.25 * minx + 0.5 * miny - 3, 6) AS y, round(minx, 6) AS back_x, round(miny, 6) AS back_y FROM c""")
def affine_round_trip(spark: SparkSession, d: str) -> DataFrame:
    m = [0.5, 0.25, 7.0, -0.25, 0.5, -3.0]
    b = roles.boxes(spark, d, "c")
    x, y = numbers.affine(m, F.col("minx"), F.col("miny"))
    out = b.select("page", "id", x.alias("x"), y.alias("y"))
    back_x, back_y = numbers.affine(numbers.affine_inverse(m), F.col("x"), F.col("y"))
    return out.select("page", "id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round(back_x, 6).alias("back_x"), F.round(back_y, 6).alias("back_y"))


@query(f"""WITH RECURSIVE {roles.POINTS}, p AS (SELECT DISTINCT page, x, y FROM points),
e AS (SELECT p.page, p.x, p.y, q.x AS tx, q.y AS ty FROM p JOIN p q ON p.page = q.page AND (p.x <> q.x OR p.y <> q.y)
  WHERE NOT EXISTS (SELECT 1 FROM p r WHERE r.page = p.page AND (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0)),
walk AS (SELECT page, 0::BIGINT AS corner, x, y, x AS x0, y AS y0 FROM p QUALIFY row_number() OVER (PARTITION BY page ORDER BY x, y) = 1
  UNION ALL SELECT w.page, corner + 1, tx, ty, x0, y0 FROM walk w JOIN e ON e.page = w.page AND e.x = w.x AND e.y = w.y WHERE tx <> x0 OR ty <> y0)
SELECT page, corner, x, y, round(abs(sum(x * ny - nx * y) OVER (PARTITION BY page)) / 2, 6) AS area FROM (SELECT page, corner, x, y, coalesce(lead(x) OVER w, x0) AS nx, coalesce(lead(y) OVER w, y0) AS ny FROM walk WINDOW w AS (PARTITION BY page ORDER BY corner))""")
def convex_hull(spark: SparkSession, d: str) -> DataFrame:
    return geometry.convex_hulls(roles.points(spark, d)).withColumn("area", F.round("area", 6))


@query(f"""WITH RECURSIVE {roles.PLANE}, cell AS (SELECT page, label, y, x, y * 64 + x AS k FROM plane WHERE label IN (7, 8, 9)),
near AS (SELECT a.page, a.label, a.k AS a, b.k AS b FROM cell a JOIN cell b ON a.page = b.page AND a.label = b.label AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
reach AS (SELECT page, label, k, k AS root FROM cell UNION SELECT n.page, n.label, n.b, root FROM reach r JOIN near n ON n.page = r.page AND n.label = r.label AND n.a = r.k WHERE root < n.b),
part AS (SELECT page, label, k, min(root) AS root FROM reach GROUP BY ALL)
SELECT page::BIGINT AS page, label::BIGINT AS label, row_number() OVER (PARTITION BY page, label ORDER BY root) AS component, n, miny, maxy, minx, maxx
FROM (SELECT page, label, root, count(*) AS n, min(y)::BIGINT AS miny, max(y)::BIGINT AS maxy, min(x)::BIGINT AS minx, max(x)::BIGINT AS maxx FROM part JOIN cell USING (page, label, k) GROUP BY page, label, root)""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    cells = roles.plane(spark, d).filter("label in (7, 8, 9)")
    return geometry.components(cells.select(F.col("page").cast("long"), F.col("y").cast("long"), F.col("x").cast("long"), F.col("label").cast("long")))


@query()
def fit_polyline(spark: SparkSession, d: str) -> DataFrame:
    return geometry.polylines(roles.point_stretches(spark, d))


@query(f"""WITH RECURSIVE {roles.boxes_sql("c", "c")},
m AS (SELECT page, minx, miny, maxx, maxy, 0 AS turn FROM c
  UNION ALL SELECT DISTINCT a.page, min(b.minx) AS minx, min(b.miny) AS miny, max(b.maxx) AS maxx, max(b.maxy) AS maxy, a.turn + 1 FROM m a JOIN m b ON a.page = b.page AND a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy WHERE a.turn < 20 GROUP BY a.page, a.minx, a.miny, a.maxx, a.maxy, a.turn)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY minx, miny, maxx, maxy) - 1 AS id, minx, miny, maxx, maxy FROM m WHERE turn = 20""")
def merge_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    return geometry.merge_to_fixpoint(roles.boxes(spark, d, "c"))


@query()
def merged_hulls(spark: SparkSession, d: str) -> DataFrame:
    c = roles.boxes(spark, d, "c")
    x, y = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    ends = [(F.col("minx") - 20, y), (x, F.col("miny") - 15), (F.col("maxx") + 20, y), (x, F.col("maxy") + 15)]
    corner = F.explode(F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ends]))
    return geometry.merged_hulls(c.select("page", "id", corner.alias("p")).select("page", "id", "p.x", "p.y"))


@query(f"""WITH {roles.PLANE}, r AS (SELECT s_suppkey AS page, s_suppkey % 40 + 12 AS cx, s_suppkey * 7 % 40 + 12 AS cy FROM supplier)
SELECT page, page * 10 AS id, y, x, label FROM plane JOIN r USING (page) WHERE abs(x + 0.5 - cx) + abs(y + 0.5 - cy) < 8.5""")
def labels_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    cx, cy = (F.col("s_suppkey") % 40 + 12).cast("double"), (F.col("s_suppkey") * 7 % 40 + 12).cast("double")
    rings = roles.table(spark, d, "supplier").select(F.col("s_suppkey").alias("page"), (F.col("s_suppkey") * 10).alias("id"), F.array(cx - 8.5, cx, cx + 8.5, cx).alias("x"), F.array(cy, cy - 8.5, cy, cy + 8.5).alias("y"))
    return geometry.labels_in_rings(roles.plane(spark, d), rings)


@query()
def endpoint_merges(spark: SparkSession, d: str) -> DataFrame:
    b = roles.boxes(spark, d, "s")
    return geometry.endpoint_merges(b.select("page", F.lit("H").alias("label"), "id", F.col("minx").alias("x0"), F.col("miny").alias("y0"), F.col("maxx").alias("x1"), F.col("maxy").alias("y1")))


@query()
def xy_cut_reading_order(spark: SparkSession, d: str) -> DataFrame:
    return geometry.reading_order(roles.boxes(spark, d, "s"))


@query(f"""{_BOXES}, g AS (SELECT page, id, (id % 4 + 6)::INTEGER AS label, minx AS x0, miny AS y0, maxx AS x1, maxy AS y1, sqrt((maxx - minx) ** 2 + (maxy - miny) ** 2) AS length, (id % 11) / 100.0::DOUBLE AS error FROM c),
r AS (SELECT page, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM s GROUP BY page),
k AS (SELECT g.*, [(x1 - x0) * (b.miny - y0) - (y1 - y0) * (b.minx - x0), (x1 - x0) * (b.miny - y0) - (y1 - y0) * (b.maxx - x0), (x1 - x0) * (b.maxy - y0) - (y1 - y0) * (b.minx - x0), (x1 - x0) * (b.maxy - y0) - (y1 - y0) * (b.maxx - x0)] AS side
  FROM g JOIN r b USING (page) WHERE x0 <= b.maxx AND x1 >= b.minx AND y0 <= b.maxy AND y1 >= b.miny)
SELECT page, id, label, round(length, 6) AS length, error FROM k WHERE list_min(side) <= 0 AND list_max(side) >= 0 AND error < 0.1 AND length >= 0.008 * 1000 AND length > CASE label WHEN 7 THEN 0 WHEN 6 THEN NULL ELSE 10 END""")
def filtered_segments(spark: SparkSession, d: str) -> DataFrame:
    corners = [F.col(c).alias(v) for c, v in (("minx", "x0"), ("miny", "y0"), ("maxx", "x1"), ("maxy", "y1"))]
    c = roles.boxes(spark, d, "c").select("page", "id", (F.col("id") % 4 + 6).cast("int").alias("label"), *corners, F.hypot(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")).alias("length"), ((F.col("id") % 11) / F.lit(100.0)).alias("error"))
    planes = c.select("page").distinct().select("page", F.lit(1000).alias("width"), F.lit(1400).alias("height"))
    region = roles.boxes(spark, d, "s").groupBy("page").agg(*[f(n).alias(n) for f, n in ((F.min, "minx"), (F.min, "miny"), (F.max, "maxx"), (F.max, "maxy"))])
    kept = segments.in_region(segments.long_enough(segments.well_fitted(c, planes, min_length=0.008)), region)
    return kept.select("page", "id", "label", F.round("length", 6).alias("length"), "error")


@query(f"""WITH RECURSIVE {roles.boxes_sql("c", "c")}, {roles.boxes_sql("s", "s")},
sheet AS (SELECT DISTINCT page FROM c),
t AS (SELECT sheet.page, '' AS path, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, 1000.0::DOUBLE AS x1, 1000.0::DOUBLE AS y1, e.id, e.label, e.pos, e.lo, e.hi FROM sheet JOIN
    (SELECT page, id, CASE WHEN id % 2 = 0 THEN 'H' ELSE 'V' END AS label, CASE WHEN id % 2 = 0 THEN miny ELSE minx END AS pos, CASE WHEN id % 2 = 0 THEN minx ELSE miny END - 300 AS lo, CASE WHEN id % 2 = 0 THEN maxx ELSE maxy END + 300 AS hi FROM s
     UNION ALL SELECT page, -1, 'Z', 0, 0, 0 FROM sheet) e ON e.page = sheet.page
  UNION ALL
  SELECT page, path || '/' || k, CASE WHEN cut.label = 'V' AND k = 1 THEN cut.pos ELSE x0 END, CASE WHEN cut.label = 'H' AND k = 1 THEN cut.pos ELSE y0 END, CASE WHEN cut.label = 'V' AND k = 0 THEN cut.pos ELSE x1 END, CASE WHEN cut.label = 'H' AND k = 0 THEN cut.pos ELSE y1 END, id, label, pos, lo, hi
  FROM (SELECT *, CASE WHEN label = cut.label THEN pos > cut.pos ELSE least(hi, CASE WHEN label = 'H' THEN x1 ELSE y1 END) - greatest(lo, cut.pos, CASE WHEN label = 'H' THEN x0 ELSE y0 END) > greatest(0, least(hi, cut.pos) - greatest(lo, CASE WHEN label = 'H' THEN x0 ELSE y0 END)) AND pos BETWEEN CASE WHEN label = 'H' THEN y0 ELSE x0 END AND CASE WHEN label = 'H' THEN y1 ELSE x1 END END AS late
    FROM (SELECT *, first_value({{'id': id, 'label': label, 'pos': pos}}) OVER (PARTITION BY page, path ORDER BY label = 'Z', crosses, label, pos, id) AS cut
      FROM (SELECT t.page, path, x0, y0, x1, y1, t.id, label, pos, lo, hi, coalesce(bool_or(CASE WHEN label = 'H' THEN pos BETWEEN greatest(c.miny, y0) AND least(c.maxy, y1) ELSE pos BETWEEN greatest(c.minx, x0) AND least(c.maxx, x1) END), false) AS crosses
        FROM t LEFT JOIN c ON c.page = t.page AND c.minx < x1 AND c.maxx > x0 AND c.miny < y1 AND c.maxy > y0 GROUP BY ALL))) q, (VALUES (0), (1)) v(k)
  WHERE cut.label <> 'Z' AND cut.id <> id AND (label = 'Z' OR late = (k = 1)) AND cut.pos > CASE WHEN cut.label = 'H' THEN y0 ELSE x0 END AND cut.pos < CASE WHEN cut.label = 'H' THEN y1 ELSE x1 END)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY path) AS leaf, path, x0 AS minx, y0 AS miny, x1 AS maxx, y1 AS maxy FROM t WHERE label = 'Z' AND NOT EXISTS (SELECT 1 FROM t u WHERE u.page = t.page AND u.path = t.path || '/0')""")
def page_split_order(spark: SparkSession, d: str) -> DataFrame:
    num = lambda x: F.lit(float(x))
    frame = roles.boxes(spark, d, "c").select("page").distinct().select("page", F.lit("frame").alias("kind"), F.lit(0).cast("long").alias("id"), num(0).alias("x0"), num(0).alias("y0"), num(1000).alias("x1"), num(1000).alias("y1"))
    box = roles.boxes(spark, d, "c").select("page", F.lit("content").alias("kind"), F.col("id").cast("long").alias("id"), F.col("minx").alias("x0"), F.col("miny").alias("y0"), F.col("maxx").alias("x1"), F.col("maxy").alias("y1"))
    flat = F.col("id") % 2 == 0
    line = roles.boxes(spark, d, "s").select("page", F.when(flat, "H").otherwise("V").alias("kind"), F.col("id").cast("long").alias("id"), F.when(flat, F.col("minx") - 300).otherwise(F.col("minx")).alias("x0"), F.when(flat, F.col("miny")).otherwise(F.col("miny") - 300).alias("y0"), F.when(flat, F.col("maxx") + 300).otherwise(F.col("minx")).alias("x1"), F.when(flat, F.col("miny")).otherwise(F.col("maxy") + 300).alias("y1"))
    leaves = pages.split_pages(frame.unionByName(box).unionByName(line))
    return leaves.select("page", "leaf", "path", F.array_min("x").alias("minx"), F.array_min("y").alias("miny"), F.array_max("x").alias("maxx"), F.array_max("y").alias("maxy"))
