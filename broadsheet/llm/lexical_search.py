r"""Ranked lexical search over term-bucketed postings, in integers.

The index is a table of postings (bucket, slice, term, row, doc_id, n, tf). A rare term's postings lie in
the bucket of its hash. Terms in more than ``hot`` documents share bucket 0, which is cut into slices
by document: there a document's frequent terms stand side by side, so their scores are summed before
anything is shuffled, and no term's postings meet in one task. Item terms are joined in blocks of at most
``block_terms`` rows (a bound on what is broadcast); every match gives an integer score, scores are summed
by item and document, and row_number takes the best ``top`` of each item. Ranks are cut in every task
before they meet.

Terms are runs of letters, digits and characters above U+007F; only A-Z are lower-cased. Null and empty texts
have no terms and are no documents for the statistics. Repeated rows are documents of their own. Rows of one
item_id form one item with the terms of all its texts; a null item_id is an item too. Equal scores go by
ascending doc_id (null first). Documents with score 0 aren't listed; an item without matches has no rows.
An empty table on either side gives an empty result; other columns are ignored. Texts of any length are
taken whole. All products stay below 2^63 up to 25 * n * N < 9 * 10^18.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters between terms.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Search:
    top: int = 20
    hot: int = 5_000  # documents from which a term is frequent
    bucket_rows: int = 200_000  # postings in a bucket of rare terms, about
    slice_rows: int = 5_000  # documents in a slice of the frequent terms, about
    block_terms: int = 100_000  # item terms that are broadcast at once


@dataclass(frozen=True)
class Index:
    """Postings, the terms with df, weight and bucket, and the corpus counts."""

    postings: DataFrame
    terms: DataFrame
    documents: int
    length: int


def _split(text: Column) -> Column:
    """The pieces between separators; the first and the last may be empty."""
    return F.split(F.coalesce(text, F.lit("")), BETWEEN, -1)


def _lowered(term: Column) -> Column:
    """A-Z to a-z alone; a term of one byte a character takes the short way."""
    return F.when(F.octet_length(term) == F.char_length(term), F.lower(term)).otherwise(F.translate(term, UPPER, LOWER))


def build_index(docs: DataFrame, wanted: DataFrame | None = None, how: Search = Search(), text: str = "text") -> Index:
    """The index of all documents; with ``wanted`` (a column term, distinct) its postings are of these terms only."""
    split = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), _split(F.col(text)).alias("pieces"))
    blank = lambda i: (F.element_at("pieces", i) == "").cast("long")
    n = F.size("pieces") - blank(1) - F.when(F.size("pieces") > 1, blank(-1)).otherwise(F.lit(0))
    # a blank, which is no term, stands for the document itself
    head = " "
    found = split.select("row", "doc_id", n.alias("n"), F.explode(F.concat(F.array(F.lit(head)), "pieces")).alias("term")).filter("term != ''")
    found = found.select("row", "doc_id", "n", _lowered(F.col("term")).alias("term"))
    if wanted is not None:
        # written, head and all, so Spark knows its size before it joins
        found = found.join(written(wanted.select("term").unionByName(docs.sparkSession.createDataFrame([(head,)], "term string")), "wanted"), "term", "left_semi")
    counted = written(found.groupBy("row", "doc_id", "n", "term").agg(F.count(F.lit(1)).alias("tf")), "counted")
    own = F.col("term") == head
    counts = written(counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("length"), F.count_if(F.col("n") > 0).alias("documents")), "terms")
    documents, length, rare = counts.agg(F.coalesce(F.max(F.when(own, F.col("documents"))), F.lit(0)), F.coalesce(F.max(F.when(own, F.col("length"))), F.lit(0)), F.coalesce(F.sum(F.when(~own & (F.col("df") <= how.hot), F.col("df"))), F.lit(0))).first()
    buckets = max(1, math.ceil(rare / how.bucket_rows))
    slices = max(1, math.ceil(documents / how.slice_rows))
    bucket = F.when(F.col("df") > how.hot, F.lit(0)).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int") + 1)
    weight = F.floor(1000 * F.log((F.lit(2 * documents + 2).cast("double")) / (2 * F.col("df") + 1))).cast("long")
    terms = counts.filter(~own).select("term", "df", weight.alias("w"), bucket.alias("bucket"))
    laid = counted.join(terms.select("term", "bucket"), "term")
    laid = laid.withColumn("slice", F.when(F.col("bucket") == 0, F.pmod(F.xxhash64("row"), F.lit(slices))).otherwise(F.lit(0)).cast("int"))
    laid = laid.repartition(slices + buckets, "bucket", "slice").sortWithinPartitions("bucket", "slice", "row", "term")
    return Index(written(laid, "postings"), terms, documents, length)


def item_terms(items: DataFrame, text: str = "text") -> DataFrame:
    """item_id, term and how often the item has it."""
    terms = items.select("item_id", F.explode(_split(F.col(text))).alias("term")).filter("term != ''")
    return terms.select("item_id", _lowered(F.col("term")).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def match_score(index: Index) -> Column:
    """A match's integer score without its weight, over tf and n."""
    m = F.expr(f"75L + ((25L * n * {index.documents}L) div {max(index.length, 1)}L)")
    return F.call_function("div", F.lit(1_000_000_000).cast("long") * F.col("tf"), F.lit(1000).cast("long") * F.col("tf") + F.lit(12).cast("long") * m)


def search(index: Index, asked: DataFrame, how: Search = Search()) -> DataFrame:
    """item_id, rank, doc_id and score: the best documents of each item in ``asked`` (item_id, term, times)."""
    weighted = written(asked.join(index.terms, "term").select("item_id", "term", "bucket", (F.col("times") * F.col("w")).alias("weight")), "asked")
    parts = max(1, math.ceil(weighted.count() / how.block_terms))
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    best = None
    for b in range(parts):
        block = F.broadcast(weighted if parts == 1 else weighted.filter(part == b))
        matches = index.postings.join(block, ["bucket", "term"]).select("item_id", "row", "doc_id", (F.col("weight") * match_score(index)).alias("score"))
        sums = matches.groupBy("item_id", "row", "doc_id").agg(F.sum("score").alias("score")).filter("score > 0")
        rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"), F.asc("row")))
        found = sums.withColumn("rank", rank).filter(F.col("rank") <= how.top).select("item_id", "rank", "doc_id", "score")
        best = found if best is None else best.unionByName(found)
    return best


def lexical_search(docs: DataFrame, items: DataFrame, how: Search = Search()) -> DataFrame:
    """The best documents of each item, over an index of the terms that the items ask for."""
    asked = written(item_terms(items), "item-terms")
    return search(build_index(docs, asked.select("term").distinct(), how), asked, how)


def oracle(how: Search = Search()) -> str:
    """DuckDB: all matches summed by item and document."""
    terms = lambda key, table: f"SELECT {key}, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM {table} WHERE text IS NOT NULL"
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, * FROM documents),
t AS (SELECT r, doc_id, term, count(*)::BIGINT AS tf FROM ({terms("r, doc_id", "docs")}) GROUP BY ALL),
len AS (SELECT r, sum(tf)::BIGINT AS n FROM t GROUP BY r),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM len),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, c GROUP BY term, docs),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM ({terms("item_id", "benchmark")}) GROUP BY ALL),
s AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))))::BIGINT AS score FROM q JOIN t USING (term) JOIN w USING (term) JOIN len USING (r), c GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank FROM s WHERE score > 0) WHERE rank <= {how.top}"""
