r"""Quality rules with cross-document line frequency.

Lines are trimmed and lower-cased and runs of white space become one space;
their hash is counted over the distinct documents of each host (texts that are
equal count once). A line in more than ``max_docs`` distinct documents of a host, and in
more than ``max_share`` of them, is boilerplate there; its words are removed from every
document of the host, and a document that keeps less than ``min_left`` of its words is
rejected. ``line_rules`` gives the verdict, ``cleaned_text`` also the text that is left. Before that, two rules on the text itself reject documents with under 50
words or with half of their words in repeated 3-word windows.

Null text counts as empty and fails the base rules; a null host is the host ''.
Repeated rows keep one row each. Any length of text is judged whole. An empty table gives an
empty result. Columns of the input with a name of the result are replaced; a
missing host column isn't allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import written

WORD = r"[^ \t\n\x0B\f\r]+"
SPACE = r"[ \t\n\x0B\f\r]+"
SYMBOL = r"[#*$%&|<>]"
#: Of the 64 bits that carry a window's hash and position, those of the position.
POSITION_BITS = 30


@dataclass(frozen=True)
class LineRules:
    max_docs: int = 20
    max_share: float = 0.002
    min_left: float = 0.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: str) -> Column:
    """Words inside 3-word windows that occur twice or more in the array column ``words``.

    Window hashes, cut to 34 bits and followed by their position, are sorted as
    plain longs; neighbours with equal bits are candidates. Only candidates are
    compared again by their words. Covered words follow from the gaps between the
    sorted positions of repeated windows.
    """
    w, n = F.col(words), F.size(words)
    mask = F.lit(-1 << POSITION_BITS)
    packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]).bitwiseAND(mask).bitwiseOR(i.cast("long")))
    return F.when(n < 4, F.array().cast("array<long>")).otherwise(F.sort_array(packed))


def _near(column: str) -> Column:
    """Positions whose neighbour in sorted order has the same hash bits."""
    s, last = F.col(column), F.size(column) - 1
    same = lambda x, y: F.shiftright(x, POSITION_BITS) == F.shiftright(y, POSITION_BITS)
    keep = lambda x, i: ((i > 0) & same(x, s[F.greatest(i - 1, F.lit(0))])) | ((i < last) & same(x, s[F.least(i + 1, last)]))
    return F.transform(F.filter(s, keep), lambda x: x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int"))


def _windows(words: str, at: str) -> Column:
    w = F.col(words)
    return F.sort_array(F.transform(F.col(at), lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("t"), i.alias("i"))))


def _equal(column: str) -> Column:
    s, last = F.col(column), F.size(column) - 1
    keep = lambda x, i: ((i > 0) & (x["t"] == s[F.greatest(i - 1, F.lit(0))]["t"])) | ((i < last) & (x["t"] == s[F.least(i + 1, last)]["t"]))
    return F.sort_array(F.transform(F.filter(s, keep), lambda x: x["i"]))


def _covered(column: str) -> Column:
    s, last = F.col(column), F.size(column) - 1
    gaps = F.transform(s, lambda x, i: F.when(i == last, F.lit(3)).otherwise(F.least(F.lit(3), s[F.least(i + 1, last)] - x)))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)


def base_rules(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    step = docs.select(*keep, words_of(t).alias("__w"), lines.alias("__lines"), F.regexp_count(t, F.lit(SYMBOL)).cast("long").alias("n_symbols"), F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"))
    step = step.select(*keep, "n_symbols", "word_chars", "__w", F.size("__w").cast("long").alias("n_words"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), repeated_words("__w").alias("__s"))
    step = step.withColumn("__near", _near("__s")).drop("__s")
    step = step.withColumn("__t", _windows("__w", "__near")).drop("__near", "__w")
    step = step.withColumn("__at", _equal("__t")).drop("__t")
    step = step.withColumn("n_repeat_words", F.when(F.size("__at") == 0, F.lit(0).cast("long")).otherwise(_covered("__at"))).drop("__at")
    return step.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _lines(docs: DataFrame, host: str, text: str) -> DataFrame:
    """One row for each line with a word: host, text hashes, position among all lines of the text, line hash, words."""
    t = F.coalesce(F.col(text), F.lit(""))
    norm = lambda x: F.trim(F.regexp_replace(F.lower(x), SPACE, " "))
    parts = F.filter(F.transform(F.split(t, "\n"), lambda x, i: F.struct(i.alias("at"), norm(x).alias("line"))), lambda x: x["line"] != "")
    rows = docs.select(F.coalesce(F.col(host), F.lit("")).alias("host"), *_identity(t), F.inline(parts))
    return rows.select("host", "t1", "t2", "at", F.xxhash64("line").alias("line"), (F.length("line") - F.length(F.translate("line", " ", "")) + 1).alias("words"))


def _identity(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]


def frequent_lines(docs: DataFrame, rules: LineRules, host: str = "source", text: str = "text") -> DataFrame:
    """(host, line, n_docs) above the limits. Counts are combined before each shuffle, so a line that a third of all documents share costs one row a task."""
    t = F.coalesce(F.col(text), F.lit(""))
    sizes = docs.select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.xxhash64(t).alias("t1")).groupBy("host").agg(F.count_distinct("t1").alias("host_docs"))
    seen = _lines(docs, host, text).select("host", "line", "t1").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    seen = seen.filter(F.col("n_docs") > rules.max_docs)
    return seen.join(sizes, "host").filter(F.col("n_docs") > rules.max_share * F.col("host_docs")).select("host", "line", "n_docs")


def removed_words(docs: DataFrame, frequent: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """(host, t1, t2, n_removed, gone) for texts that hold frequent lines: their words and their positions; equal texts share a row."""
    hits = _lines(docs, host, text).join(frequent, ["host", "line"], "left_semi")
    each = hits.groupBy("host", "t1", "t2", "at").agg(F.max("words").alias("words"))
    return each.groupBy("host", "t1", "t2").agg(F.sum("words").alias("n_removed"), F.collect_list("at").alias("gone"))


def _judged(docs: DataFrame, keep: list[str], rules: LineRules, host: str, text: str) -> DataFrame:
    """``keep``, which may hold __text, with the base counts, base_failed, gone, n_removed_words and kept."""
    frequent = written(frequent_lines(docs, rules, host, text), "frequent-lines")
    removed = written(removed_words(docs, frequent, host, text), "removed-words")
    t = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(*[F.col(c) for c in keep if c != "__text"], F.coalesce(F.col(host), F.lit("")).alias("__host"), t.alias("__text"), *_identity(t))
    base = base_rules(named, [*keep, "__host", "t1", "t2"], "__text").withColumnRenamed("__host", "host")
    joined = base.join(removed, ["host", "t1", "t2"], "left").withColumn("n_removed_words", F.coalesce("n_removed", F.lit(0)).cast("long"))
    depleted = F.col("n_words") - F.col("n_removed_words") < rules.min_left * F.col("n_words")
    return joined.withColumn("kept", ~F.col("base_failed") & ~depleted)


def line_rules(docs: DataFrame, rules: LineRules = LineRules(), host: str = "source", text: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, n_removed_words and kept."""
    return _judged(docs, ["doc_id"], rules, host, text).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")


def cleaned_text(docs: DataFrame, rules: LineRules = LineRules(), host: str = "source", text: str = "text") -> DataFrame:
    """doc_id, the text without the frequent lines of its host, n_removed_words and kept, for every row; the other lines stay as they are, null text becomes empty."""
    judged = _judged(docs, ["doc_id", "__text"], rules, host, text).select("doc_id", "__text", "gone", "n_removed_words", "kept")
    split = judged.withColumn("__lines", F.when(F.col("gone").isNotNull(), F.split("__text", "\n")))
    # array_except looks positions up in a set; the lines are used twice, so they stay a column and are split once a row
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("gone"))
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n")
    return split.select("doc_id", F.when(F.col("gone").isNull(), F.col("__text")).otherwise(left).alias("text"), "n_removed_words", "kept")


def oracle(rules: LineRules = LineRules()) -> str:
    word, space = r"[^ \t\n\x0B\f\r]+", r"[ \t\n\x0B\f\r]+"
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '{word}') AS w FROM d),
grams AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + o)::BIGINT AS n FROM rep, range(3) r(o) GROUP BY rid),
lines AS (SELECT rid, doc_id, host, text, pos, line, trim(regexp_replace(lower(line), '{space}', ' ', 'g'), ' ') AS norm FROM (SELECT rid, doc_id, host, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d)),
dups AS (SELECT rid, (count(*) - count(DISTINCT line))::BIGINT AS n FROM lines WHERE norm <> '' GROUP BY rid),
hosts AS (SELECT host, count(DISTINCT text) AS n FROM d GROUP BY host),
freq AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT text) AS n FROM lines WHERE norm <> '' GROUP BY host, norm) f JOIN hosts h USING (host) WHERE f.n > {rules.max_docs} AND f.n > {rules.max_share}::DOUBLE * h.n),
removed AS (SELECT rid, sum(len(string_split(norm, ' ')))::BIGINT AS n FROM lines JOIN freq USING (host, norm) GROUP BY rid),
base AS (SELECT d.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS n_removed_words
  FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN removed USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, NOT base_failed AND NOT (n_words - n_removed_words < {rules.min_left}::DOUBLE * n_words) AS kept FROM judged"""
