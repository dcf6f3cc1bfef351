"""Language-model scores from an Elias-Fano n-gram trie.

The words of the training documents are counted, then pairs, then longer runs;
a run is counted only below a context that the trie holds. Runs seen less than
``min_count`` times are pruned, after they have counted in their context's total. Level 1 holds the hashes of the distinct words, level
n the keys (node of the context, word) in context order, each as an Elias-Fano
sequence: its zeros are monotone pointers to the children of a context, and a query is a
successor search for the word relative to that context's pointer. A node holds its
discounted probability and each context its weight for the shorter context, both as
16-bit logarithms. With these

    p(w | context) = max(count - discount, 0) / count(context) + weight(context) * p(w | shorter context)

and p(w) = (count + 1) / (N + V + 1). Levels are files in the shared folder, one
for each range of contexts, which the workers map into memory; two totals by range reach the driver.

Words are those of the lower-cased (A-Z) text and one end token for each text.
Null text is empty: one end token. A null doc_id counts as the empty string in
the split. Repeated rows count and are scored each; texts are taken whole; an
empty table gives an empty result. Without training text every word is unknown.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .cluster import new_folder, ship, shuffle_cleanup
from .elias_fano import EliasFano, encode, read_arrays, write_arrays
from .substring_dedup import pack, unpack


@dataclass(frozen=True)
class Lm:
    order: int = 3
    min_count: int = 2
    discount: float = 0.75
    folds: int = 7
    held_fold: int = 2
    flush: int = 3_000_000
    range_tokens: int = 12_000_000
    splits: int = 8
    block_bytes: int = 1 << 22
    key_bits: int = 64  # of a context and a word in one number


_END = np.uint64(0x9FB21C651E98DF25)
_STEP = 4096.0
_DECODE = np.concatenate(([0.0], 10.0 ** (-(np.arange(1, 1 << 16) - 1) / _STEP)))


def quantise(p: np.ndarray) -> np.ndarray:
    """16-bit code of a probability: 1 + 4096 * -log10(p); 0 for none."""
    code = np.rint(-np.log10(np.maximum(p, 1e-15)) * _STEP) + 1
    return np.where(p > 0, np.minimum(code, 65535), 0).astype(np.uint16)


@dataclass(frozen=True)
class Level:
    """A folder with a file for each range and a manifest (nodes and counts by range); the sums of both."""

    folder: str
    parts: int
    nodes: int
    total: int


class Trie:
    """The levels that exist so far. ``find`` takes any number of keys at once."""

    def __init__(self, levels: list[Level], how: Lm):
        self.how = how
        self.levels = [[read_arrays(f"{x.folder}/{part:06d}") for part in range(x.parts)] for x in levels]
        self.search = [[EliasFano(a) for a in level] for level in self.levels]
        self.first = [np.concatenate(([0], np.cumsum(read_arrays(f"{x.folder}/manifest")["n"]))) for x in levels]
        self.total = levels[0].total if levels else 0
        self.size = levels[0].nodes if levels else 0
        self.bits = (self.size + 1).bit_length()

    def contexts(self, level: int) -> int:
        """Contexts of level: the words and the start mark, or the nodes of the level before."""
        return self.size + 1 if level == 1 else int(self.first[level - 1][-1])

    def _range_of(self, level: int, key: np.ndarray) -> np.ndarray:
        parts = len(self.levels[level])
        if level == 0:
            return hash_range(key, parts)
        return context_range((key >> np.uint64(self.bits)).astype(np.int64), self.contexts(level), parts)

    def lookup(self, level: int, key: np.ndarray, values: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes of keys, -1 where there is none; with ``values`` also their count (level 0) or code, and their weight code as contexts.

        Keys are searched in order, each once, so every range is met as one slice.
        """
        none = np.zeros(len(key), np.int64)
        if not len(key) or len(self.levels) <= level or not self.levels[level]:
            return none - 1, none, none
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        distinct = ordered[new]
        back = np.empty(len(key), np.int64)
        back[order] = np.cumsum(new) - 1
        edges = np.searchsorted(self._range_of(level, distinct), np.arange(len(self.levels[level]) + 1))
        node, value, weight = (np.zeros(len(distinct), np.int64) for _ in range(3))
        for r, (arrays, search) in enumerate(zip(self.levels[level], self.search[level], strict=True)):
            a, b = edges[r], edges[r + 1]
            if b > a:
                at = search.find(distinct[a:b] - arrays["base"][0])
                node[a:b] = np.where(at >= 0, at + self.first[level][r], -1)
                if values:
                    hit = np.flatnonzero(at >= 0)
                    value[a + hit] = arrays["alpha" if level else "count"][at[hit]]
        if not values:
            return node[back], none, none
        if level + 1 < len(self.levels) and self.levels[level + 1]:
            hit = np.flatnonzero(node >= 0)
            weight[hit] = self.weights(level + 1, node[hit])
        return node[back], value[back], weight[back]

    def weights(self, level: int, context: np.ndarray) -> np.ndarray:
        """Weight codes of contexts, which ascend."""
        start = context_starts(self.contexts(level), len(self.levels[level]))
        edges = np.searchsorted(context, start)
        out = np.zeros(len(context), np.int64)
        for r, arrays in enumerate(self.levels[level]):
            a, b = edges[r], edges[r + 1]
            if b > a:
                out[a:b] = arrays["weight"][context[a:b] - start[r]]
        return out


def hash_range(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def context_starts(contexts: int, parts: int) -> np.ndarray:
    return np.arange(parts + 1) * contexts // parts


def context_range(context: np.ndarray, contexts: int, parts: int) -> np.ndarray:
    return np.searchsorted(context_starts(contexts, parts), context, "right") - 1


_tries: dict[tuple, Trie] = {}


def _trie(levels: list[Level], how: Lm) -> Trie:
    """One trie a worker process: its files are mapped, not read."""
    name = (*levels, how)
    if name not in _tries:
        _tries.clear()
        _tries[name] = Trie(levels, how)
    return _tries[name]


def sequences(block: words.Block) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with the end token behind each row, and offsets by row."""
    return np.insert(block.hashes(), block.ptr[1:], _END), block.ptr + np.arange(block.rows + 1)


def runs(trie: Trie, hashes: np.ndarray, ptr: np.ndarray, depth: int, values: bool = False) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Word of each token (-1: unknown) and its count; by level from 1 to ``depth`` the context of each token, the node of (context, word), its code and the context's weight code."""
    word, count, beyond = trie.lookup(0, hashes, values)
    begin = np.zeros(len(word), bool)
    begin[ptr[:-1]] = True
    start = trie.weights(1, np.array([trie.size]))[0] if values and len(trie.levels) > 1 and trie.levels[1] else 0
    levels = []
    node = word
    for level in range(1, depth + 1):
        context, weight = np.empty(len(word), np.int64), np.zeros(len(word), np.int64)
        context[1:], weight[1:] = node[:-1], beyond[:-1]
        context[begin], weight[begin] = (trie.size, start) if level == 1 else (-1, 0)
        use = (context >= 0) & (word >= 0)
        if level > 1:
            use &= node >= 0  # a run in the trie has its shorter run there too
        some = np.flatnonzero(use)
        found = trie.lookup(level, _key(trie, context[some], word[some]), values)
        node, code, beyond = np.full(len(word), -1, np.int64), np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        node[some], code[some], beyond[some] = found
        levels.append((context, node, code, weight))
    return word, count, levels


def _key(trie: Trie, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return context.astype(np.uint64) << np.uint64(trie.bits) | word.astype(np.uint64)


def _count(texts: DataFrame, keys: Callable[[words.Block], np.ndarray], range_of: Callable[[np.ndarray], np.ndarray], how: Lm) -> DataFrame:
    """(part, data) of sorted keys and their counts, one row for each range and ``flush`` keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            part = range_of(key)
            if (part[1:] < part[:-1]).any():
                order = np.argsort(part, kind="stable")
                key, n, part = key[order], n[order], part[order]
            edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
            return pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]], pa.int32()), pa.array([pack(key[a:b], n[a:b].astype(np.uint32)) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], ["part", "data"])

        for batch in batches:
            for block in words.blocks(batch.column(0), lower=True, limit=how.block_bytes):
                found = keys(block)
                held.append(found)
                size += len(found)
                if size >= how.flush:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return texts.mapInArrow(run, "part int, data binary")


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key, n = map(np.concatenate, zip(*(unpack(x.as_py()) for x in table["data"]), strict=True))
    order = np.argsort(key)
    key, n = key[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n, first)


def _folded(counted: DataFrame, bits: int, n_words: int, how: Lm) -> DataFrame:
    """Counts from cells (range, part of the words) to ranges.

    The children of a frequent word meet in ``splits`` tasks. What is below
    ``min_count`` there only matters for its context's total and goes on as one key a context.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        k, n = _merged(table)
        rest = np.uint64(n_words)
        k = np.where(n < how.min_count, k >> np.uint64(bits) << np.uint64(bits) | rest, k)
        order = np.argsort(k)
        k, n = k[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        return pa.table({"part": pa.array([key[0].as_py() // how.splits], pa.int32()), "data": pa.array([pack(k[first], np.add.reduceat(n, first))], pa.binary())})

    return counted.groupBy("part").applyInArrow(run, "part int, data binary")


def _ranges(counted: DataFrame, parts: int, build: Callable[[int, np.ndarray, np.ndarray], tuple[dict[str, np.ndarray], int, int]], folder: str) -> Level:
    """Build and write each range where its counts meet; a range without keys gets a file too."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        have = table.filter(pa.compute.is_valid(table["data"]))
        k, n = _merged(have) if len(have) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        arrays, nodes, total = build(part, k, n)
        write_arrays(f"{folder}/{part:06d}", arrays)
        return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([nodes], pa.int64()), "total": pa.array([total], pa.int64())})

    spark = counted.sparkSession
    every = counted.unionByName(spark.range(parts).select(F.col("id").cast("int").alias("part"), F.lit(None).cast("binary").alias("data")))
    with shuffle_cleanup(spark):
        rows = every.groupBy("part").applyInArrow(run, "part int, n long, total long").toArrow().sort_by("part")
    n, total = rows["n"].to_numpy(), rows["total"].to_numpy()
    write_arrays(f"{folder}/manifest", {"n": n, "total": total})
    return Level(folder, parts, int(n.sum()), int(total.sum()))


def _level_one(parts: int):
    def build(part: int, key: np.ndarray, n: np.ndarray):
        low = np.uint64(-(-(part << 32) // parts) << 32)
        return {**encode(key - low, (1 << 64) // parts + (1 << 33)), "base": np.array([low], np.uint64), "count": n.astype(np.uint32 if not len(n) or n.max() < 1 << 32 else np.int64)}, len(key), int(n.sum())

    return build


def _level_next(level: int, contexts: int, parts: int, bits: int, n_words: int, how: Lm):
    def build(part: int, key: np.ndarray, n: np.ndarray):
        start, end = (int(x) for x in context_starts(contexts, parts)[part : part + 2])
        context = (key >> np.uint64(bits)).astype(np.int64) - start
        total = np.bincount(context, n, end - start)
        kept = (n >= how.min_count) & (key & np.uint64((1 << bits) - 1) != np.uint64(n_words))
        share = (n - how.discount) / np.maximum(total[context], 1)
        weight = 1 - np.bincount(context[kept], share[kept], end - start)
        base = np.uint64(start << bits)
        arrays = {**encode(key[kept] - base, max(1, (end - start) << bits)), "base": np.array([base], np.uint64), "alpha": quantise(share[kept]), "weight": quantise(np.maximum(weight, 1e-9))}
        return arrays, int(kept.sum()), int(n.sum())

    return build


def held_out(how: Lm = Lm()) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(how.folds)) == how.held_fold


def train(docs: DataFrame, how: Lm = Lm(), text: str = "text") -> list[Level]:
    """The levels, learned from the documents outside the held fold."""
    spark = docs.sparkSession
    ship(spark)
    folder = new_folder(spark, "trie")
    texts = docs.filter(~held_out(how)).select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    # a word has at least two bytes with its separator: a bound on the tokens, for the number of ranges only
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(4, math.ceil(size / 6 / how.range_tokens))
    counted = _count(texts, lambda block: sequences(block)[0], lambda h: hash_range(h, parts), how)
    made = [_ranges(counted, parts, _level_one(parts), f"{folder}/1")]
    for level in range(1, how.order):
        so_far, n_words = list(made), made[0].nodes
        contexts = n_words + 1 if level == 1 else made[-1].nodes
        bits = (n_words + 1).bit_length()
        if bits + max(contexts - 1, 0).bit_length() > how.key_bits:
            raise ValueError(f"{contexts} contexts of {n_words} words need keys of more than {how.key_bits} bits: take a larger min_count or a smaller order")
        of_level = min(parts, max(1, contexts))

        def keys(block: words.Block, so_far=so_far, level=level) -> np.ndarray:
            trie = _trie(so_far, how)
            word, _, levels = runs(trie, *sequences(block), level)
            context = levels[-1][0]
            use = context >= 0
            if level > 1:  # a run whose shorter run is pruned can't be kept: one key a context holds them for its total
                word = np.where(levels[-2][1] >= 0, word, trie.size)
            return _key(trie, context[use], word[use])

        def range_of(key: np.ndarray, contexts=contexts, of_level=of_level, bits=bits, n_words=n_words) -> np.ndarray:
            # a range is dealt to cells by word: consecutive words are hashes' order, so cells are even
            cell = (key & np.uint64((1 << bits) - 1)) * np.uint64(how.splits) // np.uint64(n_words + 1)
            return context_range((key >> np.uint64(bits)).astype(np.int64), contexts, of_level) * how.splits + cell.astype(np.int64)

        if not contexts:
            break
        counted = _folded(_count(texts, keys, range_of, how), bits, n_words, how)
        made.append(_ranges(counted, of_level, _level_next(level, contexts, of_level, bits, n_words, how), f"{folder}/{level + 1}"))
    return made


def token_log10(trie: Trie, hashes: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training count, log10 p(w) and log10 p(w | context) of each token."""
    _, count, levels = runs(trie, hashes, ptr, len(trie.levels) - 1, values=True)
    single = (count + 1.0) / (trie.total + trie.size + 1)
    p = single
    for context, _, code, weight in levels:
        p = np.where(context >= 0, _DECODE[code] + _DECODE[weight] * p, p)
    return count, np.log10(single), np.log10(p)


def score_documents(docs: DataFrame, how: Lm = Lm(), text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row."""
    levels = train(docs, how, text)
    total = levels[0].total

    @F.arrow_udf("struct<n_tokens: bigint, n_known: bigint, base_score: double, score: double>")
    def scored(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = _trie(levels, how)
        for texts in column:
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]]
            for block in words.blocks(texts, lower=True, limit=how.block_bytes):
                hashes, ptr = sequences(block)
                count, base, full = token_log10(trie, hashes, ptr)
                for to, x in zip(out, (np.diff(ptr), np.add.reduceat((count > 0).astype(np.int64), ptr[:-1]), np.add.reduceat(base, ptr[:-1]), np.add.reduceat(full, ptr[:-1])), strict=True):
                    to.append(x)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in out], ["n_tokens", "n_known", "base_score", "score"])

    found = docs.select("doc_id", held_out(how).alias("held_out"), scored(F.col(text)).alias("s"))
    return found.select("doc_id", "held_out", "s.n_tokens", "s.n_known", F.lit(total).cast("long").alias("train_tokens"), "s.base_score", "s.score")
