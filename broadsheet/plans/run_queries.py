"""Experiment-log analytics over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dims import BACKBONES
from ..operators import datasets, runs
from . import roles
from .registry import query

_L = f"WITH {roles.LOG}"


@query(f"{_L} SELECT run, epoch, value, metric FROM log QUALIFY row_number() OVER (PARTITION BY run ORDER BY value DESC, epoch) = 1")
def best_epoch_metrics(spark: SparkSession, d: str) -> DataFrame:
    return runs.best_epoch(roles.log(spark, d))


@query(f"{_L} SELECT run, count(*)::BIGINT AS n_epochs FROM log GROUP BY run HAVING count(*) = 66")
def complete_runs_only(spark: SparkSession, d: str) -> DataFrame:
    return runs.complete_runs(roles.table(spark, d, "events").select(F.col("user_id").alias("run")), 66)


@query(f"{_L} SELECT run, epoch, metric, value, coalesce(value > max(value) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM log")
def running_best(spark: SparkSession, d: str) -> DataFrame:
    return runs.running_best(roles.log(spark, d))


@query("""SELECT event_type, bucket, round(m, 9) AS mean, round(CASE WHEN n > 1 THEN e END, 9) AS err, n FROM (
  SELECT event_type, user_id % 200 AS bucket, avg(value) AS m, greatest(max(value) - avg(value), avg(value) - min(value)) AS e, count(value)::BIGINT AS n FROM events GROUP BY ALL)""")
def mean_maxdev(spark: SparkSession, d: str) -> DataFrame:
    rows = roles.table(spark, d, "events").withColumn("bucket", F.col("user_id") % 200)
    return runs.mean_and_deviation(rows, ["event_type", "bucket"], "value")


@query("""WITH b AS (SELECT event_type AS backbone, (user_id % 4)::INTEGER AS tiling, CASE WHEN user_id % 3 = 0 THEN 'fpn' ELSE 'unet' END AS model, max(round(value, 0)) AS v FROM events GROUP BY ALL),
w AS (SELECT backbone, tiling, model FROM b QUALIFY row_number() OVER (PARTITION BY backbone, tiling ORDER BY v DESC, model = 'fpn' DESC) = 1)
SELECT backbone, max(model) FILTER (tiling = 0) AS "0", max(model) FILTER (tiling = 1) AS "1", max(model) FILTER (tiling = 2) AS "2", max(model) FILTER (tiling = 3) AS "3" FROM w GROUP BY backbone""")
def best_model_per_cell_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = roles.table(spark, d, "events").select(F.col("event_type").alias("backbone"), (F.col("user_id") % 4).cast("int").alias("tiling"), F.when(F.col("user_id") % 3 == 0, "fpn").otherwise("unet").alias("model"), F.round("value", 0).alias("value"))
    return runs.best_pivot(rows, "backbone", "tiling", [0, 1, 2, 3], "fpn")


@query("""SELECT event_type AS key, event_id AS ord, round(value, 0) AS value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round(value, 0) DESC, event_id DESC) = 1""")
def last_among_best(spark: SparkSession, d: str) -> DataFrame:
    rows = roles.table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("ord"), F.round("value", 0).alias("value"))
    return runs.last_best(rows, "key")


_RUNTIMES = """r AS (SELECT o_orderkey AS run, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' ELSE 'RUNNING' END AS status, o_orderpriority AS backbone, c_nationkey AS model, c_mktsegment AS gpu, (1 + c_custkey % 4) AS n_gpus, o_orderdate AS start, max(l_shipdate) AS stop
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


@query(f"""WITH {_RUNTIMES}, f AS (SELECT *, (epoch(stop)::BIGINT - epoch(start)::BIGINT) * n_gpus AS s FROM r WHERE status = 'COMPLETED' AND backbone IN ('1-URGENT', '2-HIGH', '5-LOW')
  QUALIFY row_number() OVER (PARTITION BY backbone, model, gpu ORDER BY run) = 1),
g AS (SELECT gpu, sum(s)::BIGINT AS gpu_seconds, count(*)::BIGINT AS n_runs FROM f GROUP BY gpu)
SELECT gpu, gpu_seconds, n_runs, round((SELECT sum(gpu_seconds) / sum(n_runs)::DOUBLE FROM g), 3) AS mean_gpu_seconds FROM g""")
def runtime_by_gpu(spark: SparkSession, d: str) -> DataFrame:
    stops = roles.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("stop"))
    joined = roles.table(spark, d, "orders").join(stops, F.col("o_orderkey") == F.col("l_orderkey")).join(roles.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("RUNNING").alias("status")
    rows = joined.select(F.col("o_orderkey").alias("run"), status, F.col("o_orderpriority").alias("backbone"), F.col("c_nationkey").alias("model"), F.col("c_mktsegment").alias("gpu"), F.col("o_orderdate").alias("start"), "stop", (1 + F.col("c_custkey") % 4).alias("n_gpus"))
    return runs.runtime_by_gpu(rows, ["backbone", "model", "gpu"], ["run"], ["1-URGENT", "2-HIGH", "5-LOW"])


_NOW = "2002-01-01 00:00:00"


@query(f"""WITH t AS (SELECT o_orderkey AS run, count(l_orderkey)::BIGINT AS done, epoch(TIMESTAMP '{_NOW}')::BIGINT - epoch(o_orderdate)::BIGINT AS elapsed FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' GROUP BY o_orderkey, o_orderdate)
SELECT run, elapsed, done, round(elapsed / nullif(done, 0)::DOUBLE, 3) AS seconds_per_epoch, round((12 - done) * (elapsed / nullif(done, 0)::DOUBLE), 3) AS eta_seconds FROM t WHERE elapsed <= 86400 * 365""")
def run_status_eta(spark: SparkSession, d: str) -> DataFrame:
    done = roles.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("done"))
    rows = roles.table(spark, d, "orders").filter("o_orderstatus = 'O'").join(done, "o_orderkey", "left")
    rows = rows.select(F.col("o_orderkey").alias("run"), F.lit("RUNNING").alias("status"), F.col("o_orderdate").alias("start"), F.coalesce("done", F.lit(0)).cast("long").alias("done"), F.lit(12).alias("epochs"))
    return runs.status(rows, F.lit(_NOW).cast("timestamp"), 86400 * 365)


@query("SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1")
def first_seen_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = roles.table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")
    return runs.first_seen(rows, ["o_custkey", "o_orderstatus"], ["o_orderkey"])


@query("""SELECT n_nationkey AS nation, s AS status, coalesce(c, 0)::BIGINT AS n FROM nation CROSS JOIN (VALUES ('F'), ('O'), ('P'), ('X')) t(s)
LEFT JOIN (SELECT c_nationkey, o_orderstatus, count(*) AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) ON c_nationkey = n_nationkey AND o_orderstatus = s""")
def grid_left_histogram(spark: SparkSession, d: str) -> DataFrame:
    grid = roles.table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.explode(F.array(*map(F.lit, "FOPX"))).alias("status"))
    done = roles.table(spark, d, "orders").join(roles.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), F.col("o_orderstatus").alias("status"))
    return runs.grid_with_counts(grid, done, ["nation", "status"])


@query("""WITH t AS (SELECT o_orderpriority AS gpu, o_custkey AS params, count(*)::BIGINT AS n FROM orders GROUP BY ALL)
SELECT gpu, params, n FROM t QUALIFY row_number() OVER (PARTITION BY gpu ORDER BY n, params) = 1 AND n < 5""")
def task_fetch_min_n(spark: SparkSession, d: str) -> DataFrame:
    tasks = roles.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("gpu"), F.col("o_custkey").alias("params")).agg(F.count(F.lit(1)).alias("n"))
    return runs.next_tasks(tasks, 5)


@query(f"""{_L} SELECT run, epoch, metric, value, round(m, 9) AS mean FROM (SELECT *, avg(value) OVER w AS m, count(*) OVER w AS k FROM log WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE k = 5""")
def running_mean_valid(spark: SparkSession, d: str) -> DataFrame:
    return runs.moving_mean(roles.log(spark, d), "run", ["epoch"], "value", 5)


@query(f"""{_L}, c AS (SELECT *, CASE WHEN lag(metric) OVER (PARTITION BY run ORDER BY epoch) <> metric THEN 1 ELSE 0 END AS ch FROM log),
i AS (SELECT *, sum(ch) OVER (PARTITION BY run ORDER BY epoch)::BIGINT AS island FROM c) SELECT run, island, metric, count(*)::BIGINT AS length FROM i GROUP BY ALL""")
def gaps_and_islands(spark: SparkSession, d: str) -> DataFrame:
    return runs.islands(roles.log(spark, d), "run", ["epoch"], "metric")


@query("""SELECT key, count(*)::BIGINT AS n, round(avg(value), 9) AS mean FROM (SELECT json_extract_string(props, '$.k')::INTEGER % 10 AS key, value FROM events) GROUP BY key""")
def json_config_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = roles.table(spark, d, "events").select((F.from_json("props", "k int")["k"] % 10).alias("key"), "value")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 9).alias("mean"))


@query("""SELECT grp, (event_id)::BIGINT AS event_id, batch, n_batches FROM (SELECT event_type AS grp, event_id, ((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 7)::INTEGER AS batch, (count(*) OVER (PARTITION BY event_type) // 7)::INTEGER AS n_batches FROM events) WHERE batch < n_batches""")
def batch_drop_remainder(spark: SparkSession, d: str) -> DataFrame:
    rows = roles.table(spark, d, "events").select(F.col("event_type").alias("grp"), "event_id")
    return datasets.batches(rows, ["event_id"], 7)


_SAMPLES = f"""s AS (SELECT {list(BACKBONES)}[event_id % 10 + 1] AS backbone, CASE WHEN user_id % 2 = 0 THEN 'fpn' ELSE 'unet' END AS model, ['blkx', 'blk', 'sep'][user_id % 3 + 1] AS labels,
(event_id % 4)::INTEGER AS tiling, (user_id % 5 + 1)::INTEGER AS fold, (event_id % 20) / 20.0::DOUBLE AS partial, round(value, 0) / 1000 AS value, event_id AS ord FROM events)"""


def _samples(spark: SparkSession, d: str) -> DataFrame:
    user, event = F.col("user_id"), F.col("event_id")
    pick = lambda values, i: F.array(*map(F.lit, values))[i.cast("int")]
    return roles.table(spark, d, "events").select(pick(BACKBONES, event % 10).alias("backbone"), pick(("fpn", "unet"), user % 2).alias("model"), pick(("blkx", "blk", "sep"), user % 3).alias("labels"), (event % 4).cast("int").alias("tiling"), (user % 5 + 1).cast("int").alias("fold"), ((event % 20) / F.lit(20.0)).alias("partial"), (F.round("value", 0) / 1000).alias("value"), event.alias("ord"))


_FAMILY = "CASE WHEN backbone IN ('resnet34', 'resnet50') THEN 'resnet' WHEN backbone IN ('seresnet34', 'seresnet50') THEN 'seresnet' WHEN backbone LIKE 'efficientnet%' THEN 'efficientnet' WHEN backbone IN ('inceptionv3', 'vgg16') THEN backbone ELSE 'other' END"


@query(f"""WITH {_SAMPLES}, f AS (SELECT *, {_FAMILY} AS family FROM s),
e AS (SELECT model, family, backbone, value, min(ord) OVER (PARTITION BY model, family) AS seen FROM f QUALIFY row_number() OVER (PARTITION BY model, family ORDER BY value DESC, ord DESC) = 1),
m AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY value DESC, seen DESC) = 1 AS best_of_model, min(seen) OVER (PARTITION BY model) AS model_seen FROM e)
SELECT model, family, backbone, value, best_of_model, best_of_model AND row_number() OVER (PARTITION BY best_of_model ORDER BY value DESC, model_seen DESC) = 1 AS best FROM m""")
def best_backbone_family(spark: SparkSession, d: str) -> DataFrame:
    return runs.family_best(_samples(spark, d))


@query(f"""WITH {_SAMPLES}, tool AS (SELECT ['blkx', 'blk', 'sep', 'none'][(c_custkey % 4 + 1)] AS labels, (c_nationkey % 4)::INTEGER AS tiling, max(c_acctbal) / 20000 AS value FROM customer GROUP BY ALL),
c AS (SELECT labels, tiling, backbone, model, value FROM s QUALIFY row_number() OVER (PARTITION BY labels, tiling, backbone ORDER BY value DESC, model) = 1),
t AS (SELECT labels, tiling, greatest(max(c.value), coalesce(max(tool.value), 0), 0) AS top FROM c LEFT JOIN tool USING (labels, tiling) GROUP BY ALL)
SELECT c.*, top, value = top AS is_best FROM c JOIN t USING (labels, tiling)""")
def best_against_tool(spark: SparkSession, d: str) -> DataFrame:
    labels = F.array(*map(F.lit, ("blkx", "blk", "sep", "none")))[(F.col("c_custkey") % 4).cast("int")]
    tool = roles.table(spark, d, "customer").groupBy(labels.alias("labels"), (F.col("c_nationkey") % 4).cast("int").alias("tiling")).agg((F.max("c_acctbal") / 20000).alias("value"))
    return runs.best_against_tool(_samples(spark, d), tool)


@query(f"""WITH {_SAMPLES}, d AS (SELECT tiling, backbone, model FROM s ORDER BY ord LIMIT 1), n AS (SELECT i / 10.0::DOUBLE AS partial FROM range(11) r(i))
SELECT labels, partial, value FROM s JOIN d USING (tiling, backbone, model) JOIN n USING (partial) WHERE fold = 1 QUALIFY row_number() OVER (PARTITION BY labels, partial ORDER BY ord DESC) = 1""")
def score_by_fraction(spark: SparkSession, d: str) -> DataFrame:
    return runs.by_fraction(_samples(spark, d), ["blkx", "blk", "sep"])
