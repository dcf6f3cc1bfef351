"""Hierarchical budgeting: a token budget flows down a domain, language and source tree.

Every node's budget is shared among its children in proportion to their
weights. A child never gets more than its subtree can give (its tokens times
``max_epochs``); what it can't take goes to its siblings first, because each
level is filled to its own capacities before the parent's capacity binds.
Each leaf's budget is spent on whole epochs and then on a prefix of one more
epoch, whose order is a hash of seed, epoch and doc_id.

A null domain, language or source is the value ''. Null or empty text has no
tokens; such a row is taken when the prefix reaches it. Rows that share a doc_id
are tied: a prefix takes all of them or none. Values without a weight get 1;
a weight of 0 excludes a subtree. An empty table gives an empty result. Columns of
the input with a name of the result are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import written
from .sharding import HEX_DIGITS, hash_bits
from .words import WORD

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """Whole-number weights by level and value; ``fraction`` of all tokens is the budget."""

    domain: Mapping[str, int] = field(default_factory=dict)
    lang: Mapping[str, int] = field(default_factory=dict)
    source: Mapping[str, int] = field(default_factory=dict)
    fraction: float = 0.8
    max_epochs: int = 2
    seed: str = "mix"


#: The production mix of the registered query and the pipeline.
TARGET = Mix(domain={"d0": 4, "d1": 3, "d2": 2, "d3": 1}, lang={"en": 6, "de": 2, "fr": 2, "es": 3})


def domain_of(source: Column) -> Column:
    """Sources are dealt to four domains by their number; a source without one is in ''."""
    number = F.regexp_extract(source, r"([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), F.pmod(F.try_to_number(number, F.lit("999999999")).cast("long"), F.lit(4)).cast("string"))).otherwise(F.lit(""))


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(level: str, mix: Mix) -> Column:
    given = getattr(mix, level)
    if not given:
        return F.lit(1).cast("long")
    return F.coalesce(F.create_map(*[F.lit(x) for kv in given.items() for x in kv])[F.col(level)], F.lit(1)).cast("long")


def _fill(nodes: DataFrame, group: list[str], name: str) -> DataFrame:
    """Water-filling: children (cap, weight) of a group share ``budget``; adds ``alloc``."""
    by = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    up = by.orderBy("ratio", name)
    before, onward = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = F.coalesce(F.sum("cap").over(before), F.lit(0)) + F.col("ratio") * F.sum("weight").over(onward) <= F.col("budget")
    marked = nodes.withColumn("ratio", F.col("cap").cast("double") / F.col("weight")).withColumn("full", full)
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(by)
    return marked.withColumn("alloc", F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("budget") - taken) * F.col("weight") / open_weight)).drop("ratio", "full")


def leaf_budgets(supply: DataFrame, mix: Mix) -> DataFrame:
    """Rows (domain, lang, source, supply) to (..., budget) in whole tokens; one row a leaf throughout."""
    leaves = supply.select(*LEVELS, "supply", (F.col("supply") * mix.max_epochs).alias("cap"), *[_weight(x, mix).alias(f"w_{x}") for x in LEVELS])
    leaves = leaves.filter((F.col("w_domain") > 0) & (F.col("w_lang") > 0) & (F.col("w_source") > 0))
    langs = leaves.groupBy("domain", "lang", "w_domain", "w_lang").agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
    domains = langs.groupBy("domain", "w_domain").agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
    whole = Window.partitionBy(F.lit(0))
    top = domains.withColumn("budget", F.least(F.floor(F.sum("supply").over(whole) * F.lit(mix.fraction)), F.sum("cap").over(whole)).cast("double"))
    top = _fill(top.withColumn("weight", F.col("w_domain")), [], "domain").select("domain", F.col("alloc").alias("budget"))
    mid = _fill(langs.join(top, "domain").withColumn("weight", F.col("w_lang")), ["domain"], "lang").select("domain", "lang", F.col("alloc").alias("budget"))
    low = _fill(leaves.join(mid, ["domain", "lang"]).withColumn("weight", F.col("w_source")), ["domain", "lang"], "source")
    return low.select(*LEVELS, "supply", F.floor("alloc").cast("long").alias("budget"))


def _order(epoch: Column, doc_id: Column, mix: Mix) -> Column:
    return hash_bits(f"{mix.seed}|", epoch.cast("string"), "|", F.coalesce(doc_id.cast("string"), F.lit("")))


def mix_plan(docs: DataFrame, mix: Mix = TARGET, rows_per_bucket: int = 50_000) -> DataFrame:
    """One row a leaf: supply, budget, whole epochs and the last (order, doc_id) of the next epoch's prefix.

    ``docs`` has doc_id, the levels and n_tokens. An epoch's order is cut into hash
    ranges; sums by range find the one range of each leaf where the budget ends, and
    only its rows are ranked.
    """
    supply = docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"), F.count(F.lit(1)).alias("n"))
    plan = written(leaf_budgets(supply.drop("n"), mix).withColumn("epochs", F.when(F.col("supply") > 0, F.floor(F.try_divide(F.col("budget"), F.col("supply")))).otherwise(F.lit(0)).cast("long")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("supply")), "mix-plan")
    total = docs.count()
    bits = min(20, max(6, math.ceil(math.log2(max(1, total / rows_per_bucket)))))
    keyed = docs.join(plan, list(LEVELS)).filter(F.col("rest") > 0).select(*LEVELS, "doc_id", "n_tokens", "rest", _order(F.col("epochs") + 1, F.col("doc_id"), mix).alias("ord"))
    keyed = keyed.withColumn("bucket", F.shiftright("ord", 4 * HEX_DIGITS - bits))
    sums = keyed.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
    by_leaf = Window.partitionBy(*LEVELS).orderBy("bucket")
    edge = sums.withColumn("upto", F.sum("n").over(by_leaf.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter((F.col("upto") - F.col("n") <= F.col("rest")) & (F.col("upto") > F.col("rest")))
    edge = edge.select(*LEVELS, "bucket", (F.col("upto") - F.col("n")).alias("before"))
    # ties share one frame end: rows of one doc_id are in or out together
    inside = Window.partitionBy(*LEVELS).orderBy(F.struct("ord", "doc_id"))
    last = keyed.join(edge, [*LEVELS, "bucket"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside)).filter(F.col("upto") <= F.col("rest")).groupBy(*LEVELS).agg(F.max(F.struct("ord", "doc_id")).alias("last"))
    floor = edge.select(*LEVELS, F.shiftleft("bucket", 4 * HEX_DIGITS - bits).alias("floor"))
    return plan.join(floor, list(LEVELS), "left").join(last, list(LEVELS), "left")


def with_levels(docs: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return docs.withColumns({"n_tokens": n_tokens(F.col("text")), "domain": domain_of(text("source")), "lang": text("lang"), "source": text("source")})


def copies(mix: Mix) -> tuple[Column, Column]:
    """Whole epochs, and whether the prefix of the next epoch takes the row, for rows joined with the plan."""
    mine = F.struct(_order(F.col("epochs") + 1, F.col("doc_id"), mix).alias("ord"), F.col("doc_id").alias("doc_id"))
    # before the range where the budget ends; up to the last row inside it; or the whole epoch fits
    inside = F.when(F.col("rest") <= 0, F.lit(False)).when(F.col("floor").isNull(), F.lit(True)).otherwise((mine["ord"] < F.col("floor")) | F.coalesce(mine <= F.col("last"), F.lit(False)))
    return F.coalesce(F.col("epochs"), F.lit(0)).cast("int"), F.coalesce(inside, F.lit(False))


def mix_sources(docs: DataFrame, mix: Mix = TARGET) -> DataFrame:
    """Every row with its leaf, n_tokens, budget, epochs_full, in_prefix and copies (how often the mix takes it)."""
    base = written(with_levels(docs).select("doc_id", *LEVELS, "n_tokens"), "mix-rows")
    whole, prefix = copies(mix)
    # the written plan has a size: one row a leaf is broadcast, and no leaf's rows meet in one task
    out = base.join(written(mix_plan(base, mix), "mix-leaves"), list(LEVELS), "left").withColumns({"epochs_full": whole, "in_prefix": prefix})
    return out.select("doc_id", *LEVELS, "n_tokens", F.coalesce("budget", F.lit(0)).cast("long").alias("budget"), "epochs_full", "in_prefix", (F.col("epochs_full") + F.col("in_prefix").cast("int")).alias("copies"))


def take_mix(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows that the mix takes, each as often as it is taken, with the input's columns."""
    own = docs.columns
    leaf = [F.coalesce(F.col("lang"), F.lit("")).alias("__lang"), F.coalesce(F.col("source"), F.lit("")).alias("__source"), domain_of(F.coalesce(F.col("source"), F.lit(""))).alias("__domain")]
    base = written(with_levels(docs).select("doc_id", *LEVELS, "n_tokens"), "mix-rows")
    plan = written(mix_plan(base, mix), "mix-leaves").select(*[F.col(x).alias(f"__{x}") for x in LEVELS], "epochs", "rest", "floor", "last")
    whole, prefix = copies(mix)
    named = docs.select(F.struct(*own).alias("__row"), "doc_id", *leaf).join(plan, [f"__{x}" for x in LEVELS])
    n = named.select("__row", (whole + prefix.cast("int")).alias("__n")).filter("__n > 0")
    n = n.select("__row") if mix.max_epochs == 1 else n.select("__row", F.explode(F.sequence(F.lit(1), F.col("__n")))).select("__row")
    return n.select(*[F.col("__row")[c].alias(c) for c in own])


def _sql_fill(to: str, source: str, group: str, name: str) -> str:
    by = f"PARTITION BY {group}" if group else ""
    return f"""{to} AS (SELECT *, CASE WHEN is_full THEN cap::DOUBLE ELSE (budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({by}), 0)::BIGINT) * weight / sum(CASE WHEN NOT is_full THEN weight END) OVER ({by})::BIGINT END AS alloc
  FROM (SELECT *, coalesce(sum(cap) OVER ({by} ORDER BY cap::DOUBLE / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + cap::DOUBLE / weight * sum(weight) OVER ({by} ORDER BY cap::DOUBLE / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT <= budget AS is_full FROM ({source})))"""


def oracle(mix: Mix = TARGET) -> str:
    case = lambda level: ("CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in getattr(mix, level).items()) + " ELSE 1 END") if getattr(mix, level) else "1"
    leaf = "domain, lang, source"
    return f"""WITH base AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(source, ''), '[0-9]{{1,9}}$') THEN 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::BIGINT % 4)::VARCHAR ELSE '' END AS domain,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT {leaf}, sum(n_tokens)::BIGINT AS supply, sum(n_tokens)::BIGINT * {mix.max_epochs} AS cap, {case("domain")} AS w_domain, {case("lang")} AS w_lang, {case("source")} AS w_source FROM base GROUP BY {leaf}),
langs AS (SELECT domain, lang, w_domain, w_lang, sum(cap)::BIGINT AS cap, sum(supply)::BIGINT AS supply FROM leaves GROUP BY ALL),
domains AS (SELECT domain, w_domain, sum(cap)::BIGINT AS cap, sum(supply)::BIGINT AS supply FROM langs GROUP BY ALL),
{_sql_fill("top", f"SELECT *, w_domain AS weight, least(floor(sum(supply) OVER () * {mix.fraction}::DOUBLE), sum(cap) OVER ())::DOUBLE AS budget FROM domains", "", "domain")},
{_sql_fill("mid", "SELECT l.*, l.w_lang AS weight, t.alloc AS budget FROM langs l JOIN top t USING (domain)", "domain", "lang")},
{_sql_fill("low", "SELECT l.*, l.w_source AS weight, m.alloc AS budget FROM leaves l JOIN mid m USING (domain, lang)", "domain, lang", "source")},
plan AS (SELECT {leaf}, supply, floor(alloc)::BIGINT AS budget, CASE WHEN supply > 0 THEN floor(floor(alloc) / supply)::BIGINT ELSE 0 END AS epochs FROM low),
ranked AS (SELECT b.*, p.budget, p.epochs, p.budget - p.epochs * p.supply AS rest,
  sum(n_tokens) OVER (PARTITION BY {leaf} ORDER BY ('0x' || substr(md5('{mix.seed}|' || (p.epochs + 1)::VARCHAR || '|' || coalesce(doc_id::VARCHAR, '')), 1, {HEX_DIGITS}))::BIGINT, doc_id) AS upto FROM base b JOIN plan p USING ({leaf}))
SELECT doc_id, {leaf}, n_tokens, budget, epochs::INTEGER AS epochs_full, (rest > 0 AND upto <= rest) AS in_prefix, (epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::INTEGER AS copies FROM ranked"""
