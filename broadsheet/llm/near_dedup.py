"""Near duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles, each labelled with how often it
has occurred before, so no label repeats (a text of one to four words is one
shingle). Each of ``sketches`` hash functions samples the ``sample`` least
labels and hashes them in text order: two texts share a sketch with a chance of about
their similarity to the power ``sample``, and only if the order agrees.

Texts with equal word sequences are one text from the start. Texts that share a
sketch form a bucket. In each bucket the text that meets most others is compared with all
of them. Texts of buckets that are still in several classes are then ordered by
rare labels: their labels stand in one order, those that the fewest of these texts have first, and two texts
that are similar enough have one of their first labels in common (a fifth of all at most, the less the
nearer their sizes are). Texts that share such a label and a sketch are
compared: growing sets of leaders of each label with the members of other classes,
until every such pair is linked, joined through others, compared or ruled
out. A crowd of texts that differ from a common original, each in its own way, so
makes few pairs, because its members' rarest labels are their own. A pair is linked if its alignment m, the longest common subsequence of labels within the band that the
threshold leaves, gives m / (n1 + n2 - m) >= ``threshold``. Classes are the
connected components, found by distributed label propagation.

Null text counts as empty; all texts without words are copies of each other.
Repeated rows are copies. A null doc_id sorts before all others as a class's
representative. Long texts are compared whole. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .cluster import ship, written


@dataclass(frozen=True)
class Dedup:
    shingle: int = 5
    threshold: float = 0.8
    sketches: int = 40
    sample: int = 6
    survivors: int = 30
    widen: int = 16
    size_step: float = 1.05


_rng = np.random.default_rng(20240611)
_XOR = _rng.integers(0, 1 << 64, 1024, np.uint64)
_MULTIPLY = _rng.integers(0, 1 << 64, 1024, np.uint64) | np.uint64(1)
_PLACE = _rng.integers(0, 1 << 64, 1024, np.uint64)
_LABEL = np.uint64(0xA24BAED4963EE407)


def labels(tokens: np.ndarray, ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingles of each row in text order, and the offsets by row."""
    counts = np.diff(ptr)
    inside, to = words.starts_within(ptr, k)
    code = words.windows(tokens, k)[inside] if len(inside) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.array([words.windows(tokens[ptr[r] : ptr[r + 1]], int(counts[r]))[0] for r in short], np.uint64)
        code = np.insert(code, to[short], whole)
        to = to + np.concatenate(([0], np.cumsum(np.isin(np.arange(len(counts)), short))))
    row = np.repeat(np.arange(len(counts)), np.diff(to))
    salted = code ^ words.mix(row.astype(np.uint64) * _LABEL + _LABEL)
    order = np.sort(salted)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if len(twice):
        at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, salted), len(twice) - 1)] == salted)
        by = at[np.argsort(salted[at], kind="stable")]
        same = np.concatenate(([False], salted[by[1:]] == salted[by[:-1]]))
        place = np.arange(len(by))
        nth = place - np.maximum.accumulate(np.where(same, 0, place))
        again = nth > 0
        code = code.copy()
        code[by[again]] = words.mix(code[by[again]] + nth[again].astype(np.uint64) * _LABEL)
    return code, to


def order_sketches(code: np.ndarray, to: np.ndarray, how: Dedup) -> np.ndarray:
    """A row of ``sketches`` 64-bit hashes for each text that has labels (others: rows of zeros)."""
    n = np.diff(to)
    out = np.zeros((len(n), how.sketches), np.uint64)
    filled = np.flatnonzero(n)
    if not len(filled):
        return out
    row = np.repeat(np.arange(len(n)), n)
    part = how.survivors / np.maximum(n, 1)
    limit = np.where(part >= 1, np.uint64(0xFFFFFFFFFFFFFFFF), (np.minimum(part, 0.999) * 2.0**64).astype(np.uint64))
    limits = np.repeat(limit, n)
    need = np.minimum(n, how.sample)
    for f in range(how.sketches):
        h = (code ^ _XOR[f]) * _MULTIPLY[f]
        low = h <= limits
        kept = np.flatnonzero(low)
        lacking = np.bincount(row[kept], minlength=len(n)) < need
        if lacking.any():
            kept = np.flatnonzero(low | lacking[row])
        kept = kept[np.lexsort((h[kept], row[kept]))]
        r = row[kept]
        first = np.searchsorted(r, np.arange(len(n)))
        kept = np.sort(kept[np.arange(len(kept)) - first[r] < how.sample])
        r = row[kept]
        first = np.searchsorted(r, filled)
        nth = np.arange(len(kept)) - np.repeat(first, need[filled])
        out[filled, f] = words.mix(np.add.reduceat(words.mix(code[kept] ^ _PLACE[nth]), first) + _XOR[f])
    return out


def alignment(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """m / (n1 + n2 - m) for the longest common subsequence m of labels inside the band; below the threshold an upper bound may come back."""
    n1, n2 = len(a), len(b)
    if not n1 or not n2:
        return 0.0
    least = int(np.ceil(threshold * (n1 + n2) / (1 + threshold) - 1e-9))
    if min(n1, n2) < least:
        return min(n1, n2) / max(n1, n2)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    # of m matches in order, none lies further off the diagonal than the labels that are left over
    near = (j - i <= n2 - least) & (i - j <= n1 - least)
    i, j = i[near], j[near]
    if len(i) >= least:
        j = j[np.argsort(i)]
        if len(j) > 1 and (np.diff(j) < 0).any():
            tops: list[int] = []
            for x in j.tolist():
                at = bisect_left(tops, x)
                tops[at : at + 1] = [x]
            m = len(tops)
        else:
            m = len(j)
    else:
        m = len(i)
    return m / (n1 + n2 - m)


def _sketch(how: Dedup):
    @F.arrow_udf("struct<tid: binary, tokens: binary, bands: array<bigint>>")
    def sketch(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in column:
            ids, tokens, bands, sizes = [], [], [], []
            for block in words.blocks(texts):
                h = block.hashes()
                code, to = labels(words.mix((h >> np.uint64(32)) + np.uint64(1)), block.ptr, how.shingle)
                found = order_sketches(code, to, how)
                short = (h >> np.uint64(32)).astype(np.uint32)
                for r in range(block.rows):
                    a, b = block.ptr[r], block.ptr[r + 1]
                    ids.append(hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest())
                    tokens.append(short[a:b].tobytes())
                some = np.diff(to) > 0
                bands.append(found[some].view(np.int64).ravel())
                sizes.append(np.where(some, how.sketches, 0))
            offsets = np.concatenate(([0], np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)])))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*bands, np.zeros(0, np.int64)])))
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(tokens, pa.binary()), lists], ["tid", "tokens", "bands"])

    return sketch


def _similarity(how: Dedup):
    @F.arrow_udf("double")
    def similarity(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, mine = None, None
        for left, right in columns:
            out = []
            for a, b in zip(left, right, strict=True):
                a, b = a.as_py(), b.as_py()
                if a != last:
                    last, mine = a, _labels_of(a, how)
                out.append(alignment(mine, _labels_of(b, how), how.threshold))
            yield pa.array(out, pa.float64())

    return similarity


def _labels_of(tokens: bytes, how: Dedup) -> np.ndarray:
    t = words.mix(np.frombuffer(tokens, np.uint32).astype(np.uint64) + np.uint64(1))
    return labels(t, np.array([0, len(t)]), how.shingle)[0]


def _checked(pairs: DataFrame, tokens: DataFrame, how: Dedup) -> DataFrame:
    left, right = tokens.select(F.col("row").alias("a"), F.col("tokens").alias("ta")), tokens.select(F.col("row").alias("b"), F.col("tokens").alias("tb"))
    joined = pairs.join(right, "b").join(left, "a")
    return written(joined.select("a", "b", (_similarity(how)("ta", "tb") >= how.threshold).alias("linked")), "near-checked")


def components(links: DataFrame) -> DataFrame:
    """(row, comp) of every text with a link: the least row it reaches. Each round takes the least label of the neighbours and then that label's own label."""
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-links")
    now = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("row"), F.least("a", "m").alias("comp")), "near-labels")
    while True:
        around = both.join(now.withColumnsRenamed({"row": "b", "comp": "c"}), "b").groupBy("a").agg(F.min("c").alias("c"))
        nearer = now.join(around, now["row"] == around["a"]).select("row", "comp", F.least("comp", "c").alias("next"))
        jump = now.select(F.col("row").alias("next"), F.col("comp").alias("beyond"))
        later = written(nearer.join(jump, "next").select("row", F.least("next", "beyond").alias("comp"), (F.least("next", "beyond") < F.col("comp")).alias("moved")), "near-labels")
        if later.filter("moved").isEmpty():
            return later.select("row", "comp")
        now = later.select("row", "comp")


def joined_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes after further links: only the classes that a link touches are looked at again."""
    of = lambda side: classes.select(F.col("row").alias(side), F.col("comp").alias(f"c{side}"))
    met = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = components(met.filter("a != b"))
    renamed = moved.select(F.col("row").alias("comp"), F.col("comp").alias("new"))
    old = classes.join(renamed, "comp", "left").select("row", F.coalesce("new", "comp").alias("comp"))
    # texts that had no class until now appear under their own number
    fresh = moved.join(classes.select("row"), "row", "left_anti")
    return written(old.unionByName(fresh.select("row", "comp")), "near-classes")


def _with_class(members: DataFrame, classes: DataFrame) -> DataFrame:
    return written(members.join(classes, "row", "left").withColumn("comp", F.coalesce("comp", "row")), "near-own")


def _mixed(own: DataFrame) -> DataFrame:
    """Members (key, comp) of buckets that are in several classes."""
    several = own.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select("key")
    return own.join(several, "key", "left_semi")


def _label_lists(how: Dedup):
    @F.arrow_udf("array<bigint>")
    def lists(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for tokens in column:
            yield pa.array([_labels_of(t, how).view(np.int64) for t in tokens.to_pylist()], pa.list_(pa.int64()))

    return lists


def _needed(size: Column, other: Column, how: Dedup) -> Column:
    """Labels that two texts of these sizes must have in common."""
    return F.ceil(F.lit(how.threshold / (1 + how.threshold)) * (size + other) - F.lit(1e-9))


def _n_labels(how: Dedup) -> Column:
    n = F.floor(F.octet_length("tokens") / 4)
    return F.when(n == 0, 0).otherwise(F.greatest(n - (how.shingle - 1), F.lit(1)))


def prefix_members(open_: DataFrame, how: Dedup) -> DataFrame:
    """(key, row, pos, side, n, size, shared): the texts under each of their rarest labels; keys of one class are left out.

    ``open_`` has row, comp and tokens. All labels stand in one order, rare ones first. Of
    two texts that have ``need`` labels in common, the first common label in this order stands at most
    at place size - need + 1 of each. A text is put under a label once for each class of partner
    sizes for which the label still stands that early; a key is a label and the two size classes, ``side`` says which is the text's.
    """
    named = open_.select("row", "comp", F.explode(_label_lists(how)("tokens")).alias("label"), _n_labels(how).alias("size"))
    shared = named.groupBy("label").count().filter("count > 1")
    own = Window.partitionBy("row")
    # labels that no other text has come first; they need no record
    ranked = named.join(shared, "label").withColumn("shared", F.count(F.lit(1)).over(own)).withColumn("pos", F.col("size") - F.col("shared") + F.row_number().over(own.orderBy("count", "label")))
    size, t = F.col("size"), how.threshold
    least = F.ceil(size * t - 1e-9)
    most = F.least(F.floor(size / t + 1e-9), F.floor((size - F.col("pos") + 1) * ((1 + t) / t) - size + 1e-9))
    of = lambda n: F.floor(F.log(n) / F.lit(np.log(how.size_step)))
    early = ranked.filter((F.col("shared") >= least) & (most >= least)).select("row", "comp", "label", "pos", "size", "shared", of(size).alias("mine"), F.explode(F.sequence(of(least), of(most))).alias("other"))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    keyed = early.select(F.xxhash64("label", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "row", "comp", "pos", side.alias("side"), "size", "shared")
    keyed = written(keyed, "near-prefixes")
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select("key", "n")
    return keyed.join(groups, "key")


def _pairs(leaders: DataFrame, members: DataFrame) -> DataFrame:
    both = leaders.join(members, "key").filter(F.col("lead") != F.col("row"))
    return both.select(F.least("lead", "row").alias("a"), F.greatest("lead", "row").alias("b")).distinct()


#: Whether the list of ``bits`` by block has a row's ``bit``.
_LISTED = "shiftright(cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) & 1 = 1"


def _bits(listed: DataFrame, *by: str) -> DataFrame:
    """The places (block, bit) of a list as 32,768 bits for each block: so small that Spark can send it to a wide table instead of shuffling that."""
    return written(listed.repartition(*by).groupBy(*by).agg(F.bitmap_construct_agg("bit").alias("bits")), "near-bits")


def _among(table: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows of the table whose ``row`` is listed. Numbers of one partition follow each other, so they share blocks."""
    place = {"block": F.shiftright("row", 15), "bit": F.col("row").bitwiseAND(F.lit(32767))}
    return table.withColumns(place).join(_bits(listed.withColumns(place), "block"), "block").filter(_LISTED).select(*table.columns)


def text_classes(texts: DataFrame, every: DataFrame, how: Dedup) -> DataFrame:
    """(row, comp) of texts in classes of two or more, from (row, bands) with one row a text and the tokens of ``every`` row."""
    keyed = texts.select("row", F.posexplode("bands").alias("f", "h")).select("row", "f", F.xxhash64("f", "h").alias("key"))
    shared = keyed.groupBy("key").count().filter("count > 1")
    members = written(keyed.join(shared, "key").select("key", "f", "row", F.col("count").alias("n")), "near-members")
    tokens = written(_among(every.select("row", "tokens"), members.select("row").distinct()), "near-tokens")
    degree = members.groupBy("row").agg(F.sum("n").alias("degree"))
    first = members.join(degree, "row").groupBy("key").agg(F.max(F.struct("degree", "row")).alias("x")).select("key", F.col("x.row").alias("lead"))
    checked = _checked(_pairs(first, members.select("key", "row")), tokens, how)
    classes = components(checked.filter("linked"))
    mixed = _mixed(_with_class(members.filter("n > 2"), classes)).select("row", "comp").distinct()
    open_ = written(tokens.join(mixed, "row").join(texts, "row").select("row", "comp", "tokens", F.transform("bands", lambda h: h.bitwiseAND(F.lit(0x7FFF)).cast("smallint")).alias("bands")), "near-open")
    members = written(prefix_members(open_, how).join(open_.select("row", "bands"), "row").withColumn("prio", F.xxhash64("row")), "near-prefixes")
    largest = members.agg(F.max("n")).first()[0] or 0
    compared, share = 1, how.widen  # under a key of up to ``compared`` texts every pair has been looked at
    while compared < largest:
        # a leader's priority, as a fraction of the range, is below share / n
        chance = (F.col("prio").cast("double") / F.lit(2.0**64) + F.lit(0.5)) * F.col("n")
        lead = members.filter(chance < share).select("key", *[F.col(c).alias(f"l_{c}") for c in ("row", "comp", "prio", "pos", "side", "size", "shared", "bands")])
        need = _needed(F.col("size"), F.col("l_size"), how)
        early = (F.col("pos") <= F.col("size") - need + 1) & (F.col("l_pos") <= F.col("l_size") - need + 1) & (F.least("shared", "l_shared") >= need)
        apart = (F.col("l_comp") != F.col("comp")) & (F.col("l_prio") < F.col("prio")) & ((F.col("side") == 2) | (F.col("l_side") != F.col("side")))
        meet = F.exists(F.zip_with("bands", "l_bands", lambda x, y: x == y), lambda same: same)
        pairs = members.join(lead, "key").filter(apart & early & meet).select(F.least("l_row", "row").alias("a"), F.greatest("l_row", "row").alias("b")).distinct()
        new = _checked(pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti"), open_, how)
        checked = checked.union(new)
        links = new.filter("linked")
        compared, share = share, share * how.widen
        if compared >= largest:
            return classes if links.isEmpty() else joined_classes(classes, links)
        if not links.isEmpty():
            classes = joined_classes(classes, links)
        members = written(_mixed(_with_class(members.filter(F.col("n") > compared).drop("comp"), classes)), "near-prefixes")
        largest = members.agg(F.max("n")).first()[0] or 0
    return classes


def dedup_classes(docs: DataFrame, how: Dedup = Dedup(), text: str = "text", tie: Column | None = None, **carried: Column) -> DataFrame:
    """A row for each input row: doc_id, the carried columns, row, class_id (the least doc_id of its class), class_size, first_row (the row of that document that stays, of several that with the least ``tie``)."""
    ship(docs.sparkSession)
    tie = F.xxhash64(text) if tie is None else tie
    named = docs.select("doc_id", tie.alias("tie"), *[c.alias(n) for n, c in carried.items()], _sketch(how)(F.col(text)).alias("s"))
    own = ["doc_id", "tie", *carried]
    rows = written(named.select(*own, F.monotonically_increasing_id().alias("row"), "s.*"), "near-rows")
    # of copies one row speaks for the text; only narrow rows find it
    speaker = written(rows.groupBy("tid").agg(F.min("row").alias("text_row")), "near-speakers")
    texts = rows.select("row", "bands").join(speaker.select(F.col("text_row").alias("row")), "row", "left_semi")
    classes = text_classes(texts, rows, how).withColumnRenamed("row", "text_row")
    narrow = rows.select(*own, "row", "tid").join(speaker, "tid")
    named = written(narrow.join(classes, "text_row", "left").select(*own, "row", F.coalesce("comp", "text_row").alias("comp")), "near-named")
    heads = written(named.groupBy("comp").agg(F.min(F.struct("doc_id", "tie", "row")).alias("head"), F.count(F.lit(1)).alias("class_size")), "near-heads")
    return named.join(heads, "comp").select("doc_id", *carried, "row", F.col("head.doc_id").alias("class_id"), "class_size", F.col("head.row").alias("first_row"))


def near_dedup(docs: DataFrame, how: Dedup = Dedup()) -> DataFrame:
    """doc_id, class_id, class_size and kept (one row of each class)."""
    found = dedup_classes(docs, how)
    return found.select("doc_id", "class_id", "class_size", (F.col("row") == F.col("first_row")).alias("kept"))


def _places(docs: DataFrame) -> dict[str, Column]:
    """Where a row of Parquet files stands: its file, a block of 32,768 rows and the place in the block."""
    at = docs.metadataColumn("_metadata")
    return {"file": F.xxhash64(at["file_path"]), "block": F.shiftright(at["row_index"], 15), "bit": at["row_index"].bitwiseAND(F.lit(32767))}


def _names_rows(docs: DataFrame) -> bool:
    """Whether each row has a place of its own: not if it comes from elsewhere than Parquet files, or several from one by a join."""
    try:
        placed = docs.select(*[c.alias(n) for n, c in _places(docs).items()])
    except AnalysisException:
        return False
    blocks = placed.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.bitmap_count(F.bitmap_construct_agg("bit")).alias("places"))
    return blocks.filter("n != places").isEmpty()


def keep_one(docs: DataFrame, how: Dedup = Dedup()) -> DataFrame:
    """The input rows that stay, with the input's columns; of rows that share doc_id and class the one with the least hash of all columns.

    The rows that stay are listed by place, a bit for each row of the input. So the list is
    small enough to be sent to the documents, which otherwise would be shuffled with their texts.
    """
    own = docs.columns
    if not _names_rows(docs):
        docs = written(docs, "near-input")
    hashed = F.xxhash64(F.struct(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t]))
    found = dedup_classes(docs, how, tie=hashed, **_places(docs)).filter("row = first_row").select("file", "block", "bit")
    stay = _bits(found, "file", "block")
    placed = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)]).alias("row"), *[c.alias(n) for n, c in _places(docs).items()])
    kept = placed.join(stay, ["file", "block"]).filter(_LISTED)
    return kept.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(own)])
