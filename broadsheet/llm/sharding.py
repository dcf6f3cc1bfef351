"""Hierarchical weighted hash tree: every document descends region, rack and shard.

At each level a child draws ``-ln(u) / weight`` with ``u`` hashed from the
document's key and the child's name, and the least draw wins, so a child is
taken with a chance in proportion to its weight. A document changes its child
at a level only if it enters or leaves a child whose weight changed: movement
is confined to those subtrees.

Law ``key``: the shard follows from the key and the tree alone. Shards beyond
the planned tree stand in a region of their own, so one more shard changes no
other weight and takes documents only into itself.

A null key counts as the empty key. Null text has size 16 and the checksum of
the empty text; texts of any length count whole. Repeated rows keep one row each and get neighbouring slots. An
empty table gives an empty result. Columns of the input that bear a name of the
result are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import written

HEX_DIGITS = 13
DRAWS = 1 << (4 * HEX_DIGITS)


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


def shard_tree(n_shards: int, planned: int = 40, racks: int = 4, per_rack: int = 2) -> list[Shard]:
    """Regions of ``racks`` x ``per_rack`` shards up to ``planned``; each later shard is a region of its own."""
    out = []
    for s in range(n_shards):
        if s < planned:
            region, inside = divmod(s, racks * per_rack)
            out.append(Shard(f"g{region}", f"g{region}r{inside // per_rack}", s))
        else:
            out.append(Shard(f"x{s}", f"x{s}r0", s))
    return out


def hash_bits(*parts: Column | str) -> Column:
    """52 bits of md5 as a long."""
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("long")


def _children(nodes: list[tuple[str, float]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("at"), F.lit(name).alias("name"), F.lit(float(w)).alias("weight")) for i, (name, w) in enumerate(nodes)])


def _least(key: Column, children: Column) -> Column:
    draw = lambda c: F.struct((-F.log((hash_bits(key, "|", c["name"]) + F.lit(0.5)) / F.lit(float(DRAWS))) / c["weight"]).alias("draw"), c["at"].alias("at"))
    return F.array_min(F.transform(children, draw))["at"]


def descend(key: Column, tree: list[Shard]) -> Column:
    """The number of the shard that a key reaches."""
    tree = [s for s in tree if s.weight > 0]
    regions = list(dict.fromkeys(s.region for s in tree))
    racks = {g: list(dict.fromkeys(s.rack for s in tree if s.region == g)) for g in regions}
    weight = lambda name, field: sum(s.weight for s in tree if getattr(s, field) == name)
    region = _least(key, _children([(g, weight(g, "region")) for g in regions]))
    rack_sets = F.array(*[_children([(r, weight(r, "rack")) for r in racks[g]]) for g in regions])
    shard_sets = F.array(*[F.array(*[_children([(f"s{s.number}", s.weight) for s in tree if s.rack == r]) for r in racks[g]]) for g in regions])
    numbers = F.array(*[F.array(*[F.array(*[F.lit(s.number) for s in tree if s.rack == r]) for r in racks[g]]) for g in regions])
    # each draw is named once and used by the next level
    step = F.transform(F.array(region), lambda g: F.struct(g.alias("g"), _least(key, rack_sets[g]).alias("r")))[0]
    return F.transform(F.array(step), lambda x: numbers[x["g"]][x["r"]][_least(key, shard_sets[x["g"]][x["r"]])])[0]


def shard_documents(docs: DataFrame, n_shards: int = 40, key: str = "doc_id", text: str = "text", tree: list[Shard] | None = None, grown: list[Shard] | None = None, rows_per_bucket: int = 200_000, keep: list[str] | None = None) -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard; ``keep`` names the input columns that stay.

    Slots count from 0 in each shard in the order of a seeded hash of the key and the text's checksum.
    The order is cut into hash ranges of about ``rows_per_bucket`` rows: counts by
    range give each range's first slot and only the rows inside one range are ranked together, so no task
    gathers a shard or the rows of one key. Rows that agree in all columns are counted before they
    meet and told apart behind the ranking.
    """
    tree = tree or shard_tree(n_shards)
    grown = grown or shard_tree(n_shards + 1)
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    crc = F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    total = docs.select(key).count()
    bits = max(3, math.ceil(math.log2(max(1, total / (n_shards * rows_per_bucket)))))
    order = hash_bits("slot|", name, "|", crc.cast("string"))
    placed = docs.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("__row") if keep else F.lit(0).alias("__row"), F.col(key).alias("__key"), descend(name, tree).alias("__shard"), descend(name, grown).alias("__grown"), order.alias("__order"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("__size"), crc.alias("__crc"))
    # a map can't be a key: such rows are ranked one by one
    alike = all("map<" not in kind and "variant" not in kind for c, kind in docs.dtypes if c in keep)
    placed = placed.groupBy(*placed.columns).agg(F.count(F.lit(1)).alias("__copies")) if alike else placed.withColumn("__copies", F.lit(1).cast("long"))
    placed = written(placed.withColumn("__bucket", F.shiftright("__order", 4 * HEX_DIGITS - bits)), "shard-rows")
    counts = placed.groupBy("__shard", "__bucket").agg(F.sum("__copies").alias("n"))
    earlier = Window.partitionBy("__shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("__shard", "__bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("__shard", "__bucket").orderBy("__order", F.col("__key").asc_nulls_first(), "__size", "__crc").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("__before", F.coalesce(F.sum("__copies").over(inside), F.lit(0))).join(first, ["__shard", "__bucket"])
    slots = ranked.withColumn("__nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)))
    return slots.select(
        *[F.col("__row")[f"c{i}"].alias(c) for i, c in enumerate(keep)],
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("__shard").cast("int").alias("shard"),
        (F.col("__first") + F.col("__before") + F.col("__nth")).cast("long").alias("slot"),
        F.col("__grown").cast("int").alias("grown_shard"),
    )


def _sql_descend(tree: list[Shard], to: str) -> str:
    """DuckDB: rows (doc_id, key) of ``keyed`` to (doc_id, shard) by the three draws."""
    rows = ", ".join(f"('{s.region}', '{s.rack}', 's{s.number}', {s.number}, {s.weight}::DOUBLE)" for s in tree)
    draw = lambda n: f"-ln((('0x' || substr(md5(k || '|' || {n}), 1, {HEX_DIGITS}))::BIGINT + 0.5) / {float(DRAWS)!r})"
    return f"""{to}_tree(region, rack, leaf, number, w) AS (VALUES {rows}),
{to}_g AS (SELECT k, arg_min(region, d) AS region FROM (SELECT k, region, {draw("region")} / w AS d FROM keys, (SELECT region, sum(w) AS w FROM {to}_tree GROUP BY region)) GROUP BY k),
{to}_r AS (SELECT k, arg_min(rack, d) AS rack FROM (SELECT k, t.rack, {draw("t.rack")} / w AS d FROM {to}_g JOIN (SELECT region, rack, sum(w) AS w FROM {to}_tree GROUP BY region, rack) t USING (region)) GROUP BY k),
{to} AS (SELECT k, arg_min(number, d) AS shard FROM (SELECT k, number, {draw("leaf")} / w AS d FROM {to}_r JOIN {to}_tree USING (rack)) GROUP BY k)"""


def oracle(n_shards: int = 40) -> str:
    return f"""WITH RECURSIVE step(n, i, c) AS (
  SELECT n, 0, n::BIGINT FROM range(256) r(n) UNION ALL
  SELECT n, i + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END FROM step WHERE i < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM step WHERE i = 8),
keyed AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS text FROM documents),
keys AS (SELECT DISTINCT k FROM keyed),
{_sql_descend(shard_tree(n_shards), "now")},
{_sql_descend(shard_tree(n_shards + 1), "later")},
sized AS (SELECT doc_id, k, octet_length(encode(text))::BIGINT + 16 AS size,
  xor(coalesce(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8)), 4294967295), 4294967295::BIGINT) AS text_crc32
  FROM keyed, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, now.shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY now.shard ORDER BY ('0x' || substr(md5('slot|' || k || '|' || text_crc32::VARCHAR), 1, {HEX_DIGITS}))::BIGINT, doc_id NULLS FIRST, size) - 1 AS slot,
  later.shard::INTEGER AS grown_shard
FROM sized JOIN now USING (k) JOIN later USING (k)"""
