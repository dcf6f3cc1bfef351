"""Dataset management: calendar, names, folds, splits, grids, XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims, names
from ..operators import datasets
from ..sources import readers
from . import roles
from .registry import query

_DAYS = "e AS (SELECT d::DATE AS day, p AS part FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) s(d), (VALUES ('M'), ('A')) t(p))"
_PART = "CASE WHEN o_orderkey % 2 = 0 THEN 'M' ELSE 'A' END"


@query(f"WITH {_DAYS}, n AS (SELECT o_orderdate::DATE AS day, {_PART} AS part, count(*) AS n FROM orders GROUP BY ALL) SELECT day, part, coalesce(n, 0)::BIGINT AS n FROM e LEFT JOIN n USING (day, part)")
def edition_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Every edition of the calendar with its orders, days without any too."""
    orders = roles.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), F.expr(_PART).alias("part"))
    n = orders.groupBy("day", "part").agg(F.count(F.lit(1)).alias("n"))
    return datasets.editions(spark, "1995-01-01", "2001-12-31").join(n, ["day", "part"], "left").fillna(0, ["n"])


@query(f"SELECT o_orderkey, 'SNP2436020X-' || strftime(o_orderdate, '%Y%m%d') || '-' || (CASE WHEN {_PART} = 'A' THEN 1 ELSE 0 END)::VARCHAR || '-' || (o_custkey % 12)::VARCHAR || '-0-0' AS id FROM orders")
def edition_id_format(spark: SparkSession, d: str) -> DataFrame:
    orders = roles.table(spark, d, "orders")
    return orders.select("o_orderkey", names.edition_id(F.col("o_orderdate").cast("date"), F.expr(_PART), (F.col("o_custkey") % 12).cast("int")).alias("id"))


_FOLDS = "f AS (SELECT p_partkey, p_brand, ntile(5) OVER (ORDER BY md5(p_partkey::VARCHAR), p_partkey)::INTEGER AS fold FROM part)"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return datasets.folds(roles.table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")


@query(f"WITH {_FOLDS} SELECT * FROM f")
def folds_ntile(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d)


@query(f"WITH {_FOLDS} SELECT held, CASE WHEN fold = held THEN 'val' ELSE 'train' END AS split, count(*)::BIGINT AS n, min(p_partkey) AS first FROM f, (SELECT unnest(range(1, 6))::INTEGER AS held) GROUP BY ALL")
def train_val_split(spark: SparkSession, d: str) -> DataFrame:
    every = _parts(spark, d).withColumn("held", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return every.groupBy("held", datasets.split_of(F.col("fold"), F.col("held")).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


@query("SELECT p_partkey FROM part QUALIFY row_number() OVER (ORDER BY md5(p_partkey::VARCHAR), p_partkey) <= floor((SELECT count(*) FROM part) * 0.7 + 1e-9)")
def partial_exact_sample(spark: SparkSession, d: str) -> DataFrame:
    return datasets.exact_sample(roles.table(spark, d, "part").select("p_partkey"), "p_partkey", 0.7)


@query("""SELECT name FROM (SELECT 'img-' || p_partkey::VARCHAR || '.png' AS name FROM part UNION ALL SELECT 'WARP-img-' || p_partkey::VARCHAR || '.png' FROM part)
WHERE EXISTS (SELECT 1 FROM supplier WHERE ends_with(name, (s_suppkey * 7)::VARCHAR || '.png'))""")
def suffix_semi_join(spark: SparkSession, d: str) -> DataFrame:
    stems = roles.table(spark, d, "part").select(F.concat(F.lit("img-"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("name"))
    images = stems.unionByName(stems.select(F.concat(F.lit("WARP-"), "name").alias("name")))
    valid = roles.table(spark, d, "supplier").select(F.concat((F.col("s_suppkey") * 7).cast("string"), F.lit(".png")).alias("suffix"))
    return datasets.with_suffix(images, valid, "name")


_l = lambda xs: ", ".join(f"'{x}'" for x in xs)
_AXES = (("backbone", dims.BACKBONES, 1), ("model", dims.MODELS, 7), ("data_name", dims.LAYOUTS, 11))
_MODE = "p_partkey % 3"


@query(f"""WITH job AS (SELECT p_partkey, {", ".join(f"list_extract([{_l(xs)}], 1 + (p_partkey // {k} % {len(xs)})::INTEGER) AS {c}" for c, xs, k in _AXES)}, CASE WHEN {_MODE} = 0 THEN 'sep' ELSE 'txt' END AS labels, {_MODE} = 2 AS illustrations FROM part)
SELECT *, CASE WHEN data_name IN ({_l(dims.LARGE_LAYOUTS)}) OR (backbone = 'seresnext50' AND data_name IN ('layout_896x1280_T512x768', 'layout_768x1280_T768x512')) OR backbone IN ('seresnet50', 'efficientnetb2') OR (backbone IN ('efficientnetb1', 'seresnext50', 'inceptionresnetv2') AND model = 'fpn') THEN 'v100' ELSE 'rtx2080ti' END AS gpu,
(CASE WHEN backbone = 'seresnext50' AND model = 'fpn' AND data_name IN ({_l(dims.LARGE_LAYOUTS)}) THEN 4 ELSE 12 END)::INTEGER AS batchsize, 1::INTEGER AS fold, 4::INTEGER AS ngpus FROM job""")
def param_grid_conditional(spark: SparkSession, d: str) -> DataFrame:
    """The point of the parameter grid that each part asks for."""
    k = F.col("p_partkey")
    pick = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (F.floor(k / by) % len(xs) + 1).cast("int"))
    jobs = roles.table(spark, d, "part").select("p_partkey", *[pick(xs, by).alias(c) for c, xs, by in _AXES], F.when(k % 3 == 0, "sep").otherwise("txt").alias("labels"), (k % 3 == 2).alias("illustrations"))
    return jobs.join(F.broadcast(datasets.parameter_grid(spark)), [*(c for c, _, _ in _AXES), "labels", "illustrations"])  # a grid of fixed size


_SHAPE = "p_partkey, (64 * (p_partkey % 30 + 1))::INTEGER AS w, (32 * p_size)::INTEGER AS h, (CASE WHEN p_partkey % 4 > 0 THEN 16 * (p_partkey % 9 + 1) END)::INTEGER AS tw, (CASE WHEN p_partkey % 4 > 0 THEN 8 * p_size END)::INTEGER AS th"


@query(f"""SELECT *, 'layout_' || w::VARCHAR || 'x' || h::VARCHAR || coalesce('_T' || tw::VARCHAR || 'x' || th::VARCHAR, '') AS name FROM (SELECT {_SHAPE} FROM part)""")
def layout_name_parse(spark: SparkSession, d: str) -> DataFrame:
    """Names of layouts made from sizes and read again."""
    part, k = roles.table(spark, d, "part"), F.col("p_partkey")
    tiled = lambda c: F.when(k % 4 > 0, c).cast("int")
    sizes = [(64 * (k % 30 + 1)).cast("int"), (32 * F.col("p_size")).cast("int"), tiled(16 * (k % 9 + 1)), tiled(8 * F.col("p_size"))]
    named = part.select("p_partkey", names.layout_name(*sizes).alias("name"))
    return named.select("*", *[names.layout_part(F.col("name"), i).alias(c) for i, c in enumerate(("w", "h", "tw", "th"), 1)])


@query("""SELECT page_id, (i - 1)::INTEGER AS i, url || '/' || (i - 1)::VARCHAR AS href FROM (SELECT page_id, replace(url, '&', '%26') AS url, unnest(range(1, (page_id % 3 + 2)::BIGINT)) AS i FROM pages)""")
def xml_href_extract(spark: SparkSession, d: str) -> DataFrame:
    page = roles.table(spark, d, "pages").select("page_id", F.replace(F.col("url"), F.lit("&"), F.lit("%26")).alias("url"))
    file = lambda i: F.concat(F.lit('<m:file><m:FLocat x:href="'), F.col("url"), F.lit("/"), i.cast("string"), F.lit('"/></m:file>'))
    group = lambda use, inner: F.concat(F.lit(f'<m:fileGrp USE="{use}">'), inner, F.lit("</m:fileGrp>"))
    xml = F.concat(F.lit('<m:mets xmlns:m="urn:m" xmlns:x="urn:x">'), group("MIN", file(F.lit(9))), group("MAX", F.array_join(F.transform(F.sequence(F.lit(0), (F.col("page_id") % 3).cast("int")), file), "")), F.lit("</m:mets>"))
    return page.select("page_id", F.posexplode(readers.page_urls(xml)).alias("i", "href"))


@query("""SELECT kind, day, count(*)::BIGINT AS n FROM (SELECT 'dated' AS kind, o_orderdate::DATE AS day FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'undated', NULL FROM orders WHERE o_orderstatus = 'P') GROUP BY ALL""")
def union_corpora(spark: SparkSession, d: str) -> DataFrame:
    o = roles.table(spark, d, "orders")
    dated = o.filter("o_orderstatus <> 'P'").select(F.lit("dated").alias("kind"), F.col("o_orderdate").cast("date").alias("day"))
    undated = o.filter("o_orderstatus = 'P'").select(F.lit("undated").alias("kind"), F.lit(None).cast("date").alias("day"))
    return dated.unionByName(undated).groupBy("kind", "day").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, list_extract(['a', 'b', 'c'], 1 + (('0x' || substr(md5('seed' || c_custkey::VARCHAR), 1, 8))::BIGINT % 3)) AS page FROM customer""")
def random_page_of_edition(spark: SparkSession, d: str) -> DataFrame:
    urls = F.array(*map(F.lit, "abc"))
    return roles.table(spark, d, "customer").select("c_custkey", datasets.random_page(urls, F.col("c_custkey").cast("string"), "seed").alias("page"))
