"""Alignment of two tokenizers: groups of tokens that cover the same bytes, and how often ids are linked.

A text gets one label for each byte: no token ends there, a token of A, one of B, or one of
both. A regular expression scans the labels for the spans up to each label "both"; the labels in a
span count the tokens of its group. All A and B tokens of a group are linked.

The links of a task's documents are counted by document and id pair, and its pairs get numbers, so that
what is shuffled is a row for each pair of a batch of documents, not for each link. A pair's
documents are summed over all batches; each batch then gets the counts of its pairs back and sums them by
document. A batch holds about ``entries`` pairs of documents, whatever the number of documents.

Texts that are null or empty, or whose tokens of either side don't spell " " + text (texts with
U+2581), have no tokens: zeros and an empty string. Texts of any length are aligned whole; a
group with very many tokens on both sides is counted by distinct ids. Repeated rows count as documents
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .cluster import ship, written
from .piece_codec import Codec, encoder_of, load_codec

#: Fixed value: how byte-level vocabularies of this kind cut a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Labels of a byte: 0 no end, 1 an end of A, 2 an end of B, 3 both.
_GROUP = re.compile(rb"[^3]*3")
_PRODUCT = 64  # a group with more links is counted by distinct ids
_ENTRIES = 1 << 20


def _offsets(lengths) -> np.ndarray:
    """0 and the running sums."""
    return np.concatenate(([0], np.cumsum(np.asarray(lengths, np.int64))))


@dataclass(frozen=True)
class ByteLevel:
    """The byte strings of a byte-level vocabulary by rank, and the length in bytes of each id."""

    digest: str
    ranks: dict[bytes, int]
    surface: np.ndarray
    at: np.ndarray


def load_byte_level(path: str) -> ByteLevel:
    """A byte-level BPE file whose ids follow its merges. Printable Latin-1 characters stand for their bytes, the characters from U+0100 on for the other bytes in order."""
    raw = Path(path).read_bytes()
    model = json.loads(raw)["model"]
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte_of[ch] for ch in token): i for token, i in model["vocab"].items()}
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
        raise ValueError("ids don't follow the merges: they are no ranks")
    texts = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        texts[i] = token
    return ByteLevel(hashlib.sha256(raw).hexdigest(), ranks, np.frombuffer(b"".join(texts), np.uint8), _offsets([len(t) for t in texts]))


_made: dict[str, object] = {}


def _byte_encoder(a: ByteLevel):
    """The worker's encoder; it holds one."""
    if a.digest not in _made:
        import tiktoken

        _made.clear()
        _made[a.digest] = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=a.ranks, special_tokens={})
    return _made[a.digest]


def _spelled(ids: np.ndarray, surface: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a list of ids, and the width of each."""
    width = at[ids + 1] - at[ids]
    return surface[words.spread(at[ids], width)], width


@dataclass
class Aligned:
    """Some consecutive rows: the ids of both sides, the tokens by group (a, b), and the n + 1 offsets by row of ids and groups."""

    a: np.ndarray
    b: np.ndarray
    in_a: np.ndarray
    in_b: np.ndarray
    a_ptr: np.ndarray
    b_ptr: np.ndarray
    ptr: np.ndarray


def labels_of(a_width: np.ndarray, b_width: np.ndarray, size: int) -> np.ndarray:
    labels = np.zeros(size, np.uint8)
    labels[np.cumsum(a_width) - 1] = 1
    labels[np.cumsum(b_width) - 1] += 2
    return labels


def aligned(texts: list[str | None], b_ids: np.ndarray, b_ptr: np.ndarray, a: ByteLevel, b: Codec) -> Aligned:
    """Rows whose B ids are known, aligned with their A ids."""
    encode = _byte_encoder(a).encode_ordinary
    a_rows = [np.array(encode(" " + t), np.int64) if t else np.zeros(0, np.int64) for t in texts]
    a_ids, a_ptr = np.concatenate([*a_rows, np.zeros(0, np.int64)]), _offsets([len(r) for r in a_rows])
    b_ids = b_ids.astype(np.int64)
    want = [(" " + t).encode() if t else b"" for t in texts]
    offsets = _offsets([len(w) for w in want])
    whole = np.frombuffer(b"".join(want), np.uint8)
    (a_bytes, a_width), (b_bytes, b_width) = _spelled(a_ids, a.surface, a.at), _spelled(b_ids, b.surface, b.at)
    if not (np.array_equal(a_bytes, whole) and np.array_equal(b_bytes, whole)):
        a_to, b_to = (_offsets(w)[p] for w, p in ((a_width, a_ptr), (b_width, b_ptr)))
        same = [a_bytes[a_to[r] : a_to[r + 1]].tobytes() == w == b_bytes[b_to[r] : b_to[r + 1]].tobytes() for r, w in enumerate(want)]
        a_keep, b_keep = np.repeat(same, np.diff(a_ptr)), np.repeat(same, np.diff(b_ptr))
        a_ids, a_width, b_ids, b_width = a_ids[a_keep], a_width[a_keep], b_ids[b_keep], b_width[b_keep]
        a_ptr, b_ptr, offsets = (_offsets(np.where(same, np.diff(p), 0)) for p in (a_ptr, b_ptr, offsets))
    labels = labels_of(a_width, b_width, int(offsets[-1]))
    ends = np.cumsum([len(span) for span in _GROUP.findall((labels + 0x30).tobytes())], dtype=np.int64)
    in_a, in_b = (np.diff(_offsets(labels >> k & 1)[np.append(0, ends)]) for k in (0, 1))
    return Aligned(a_ids, b_ids, in_a, in_b, a_ptr, b_ptr, np.searchsorted(ends, offsets, "right"))


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal text of 0 to n - 1, each with a comma behind it, and the offsets."""
    texts = [b"%d," % i for i in range(n)]
    return np.frombuffer(b"".join(texts), np.uint8), _offsets([len(t) for t in texts])


def group_texts(x: Aligned, digits: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, np.ndarray]:
    """a1,a2|b1;a3|b2,b3; of all rows one after the other, and the n + 1 offsets by row; a row's text has a semicolon at its end."""
    text, at = digits
    n = x.in_a + x.in_b
    base = np.cumsum(n) - n
    ids = np.empty(len(x.a) + len(x.b), np.int64)
    ids[words.spread(base, x.in_a)] = x.a
    ids[words.spread(base + x.in_a, x.in_b)] = x.b
    width = at[ids + 1] - at[ids]
    out = text[words.spread(at[ids], width)]
    to = _offsets(width)
    out[to[base + x.in_a] - 1] = ord("|")
    out[to[base + n] - 1] = ord(";")
    return out.tobytes(), to[np.append(base, len(ids))[x.ptr]]


def links_of(x: Aligned, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, links) of the distinct id pairs of each row in order; a pair is a * wide + b."""
    row = np.repeat(np.arange(len(x.ptr) - 1), np.diff(x.ptr))
    a_at, b_at = np.cumsum(x.in_a) - x.in_a, np.cumsum(x.in_b) - x.in_b
    size = x.in_a * x.in_b
    small = np.flatnonzero(size <= _PRODUCT)
    g = np.repeat(small, size[small])
    nth = words.spread(np.zeros(len(small), np.int64), size[small])
    pair = x.a[a_at[g] + nth // x.in_b[g]] * wide + x.b[b_at[g] + nth % x.in_b[g]]
    space = (int(x.a.max(initial=0)) + 1) * wide
    keys, times = [np.sort(row[g] * space + pair)], []
    begins = np.flatnonzero(np.diff(keys[0], prepend=-1))
    times.append(np.diff(np.append(begins, len(keys[0]))))
    keys[0] = keys[0][begins]
    for g in np.flatnonzero(size > _PRODUCT).tolist():
        (ua, na), (ub, nb) = (np.unique(ids[at[g] : at[g] + n[g]], return_counts=True) for ids, at, n in ((x.a, a_at, x.in_a), (x.b, b_at, x.in_b)))
        keys.append((row[g] * space + ua[:, None] * wide + ub[None, :]).ravel())
        times.append((na[:, None] * nb[None, :]).ravel())
    if len(keys) > 1:
        found, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, back, np.concatenate(times))
        keys, times = [found], [total]
    return keys[0] // space, keys[0] % space, times[0]


class _Batch:
    """Documents of a task with their distinct pairs, until there are enough for a batch."""

    def __init__(self) -> None:
        self.columns: list[list[pa.Array]] = []
        self.entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: pa.Array, x: Aligned, wide: int, digits: tuple[np.ndarray, np.ndarray]) -> None:
        texts, to = group_texts(x, digits)
        sha = [hashlib.sha256(memoryview(texts)[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
        links = _offsets(x.in_a * x.in_b)
        row, pair, n = links_of(x, wide)
        self.columns.append([ids, *(pa.array(np.diff(v), pa.int64()) for v in (x.a_ptr, x.b_ptr, x.ptr, links[x.ptr])), pa.array(sha, pa.string())])
        self.entries.append((np.bincount(row, minlength=len(ids)), pair, n))
        self.size += len(pair)

    def tables(self, batch: int) -> Iterator[pa.RecordBatch]:
        """A row for each document with its pairs by number, then a row for each pair."""
        per_doc, pair, links = (np.concatenate(x) for x in zip(*self.entries, strict=True))
        pairs, number = np.unique(pair, return_inverse=True)
        to = _offsets(per_doc)
        step = np.diff(number, prepend=0)  # a document's numbers ascend: the first, then the steps
        first = to[:-1][per_doc > 0]
        step[first] = number[first]
        n = len(per_doc)
        columns = [pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in column]) for column in zip(*self.columns, strict=True)]
        lists = [pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(v, t)) for v, t in ((step, pa.int32()), (links, pa.int64()))]
        none = [pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch), pa.int64()), *columns, *lists, *none], _COLUMNS)
        m = len(pairs)
        empty = [pa.nulls(m, c.type) for c in (*columns, *lists)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, batch), pa.int64()), *empty, pa.array(np.arange(m), pa.int32()), pa.array(pairs, pa.int64()), pa.array(np.bincount(number, minlength=m), pa.int32())], _COLUMNS)


_COLUMNS = ["batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "step", "links", "number", "pair", "df"]


def _blocks(batches: Iterator[pa.RecordBatch], a: ByteLevel, b: Codec) -> Iterator[tuple[pa.Array, Aligned]]:
    """Document ids and their alignment, block by block."""
    encoder = encoder_of(b)
    for batch in batches:
        column = pc.fill_null(batch.column(1), "")
        for first, ids, ptr in encoder.blocks(column):
            n = len(ptr) - 1
            yield batch.column(0).slice(first, n), aligned(column.slice(first, n).to_pylist(), ids, ptr, a, b)


def token_groups(docs: DataFrame, byte_level_path: str, model_path: str, text: str = "text") -> DataFrame:
    """doc_id, a and b (the ids of both sides), in_a and in_b (how many of them each group has, in order)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((load_byte_level(byte_level_path), load_codec(model_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, *shared.value):
            lists = [pa.ListArray.from_arrays(pa.array(p, pa.int32()), pa.array(v, pa.int32())) for p, v in ((x.a_ptr, x.a), (x.b_ptr, x.b), (x.ptr, x.in_a), (x.ptr, x.in_b))]
            yield pa.RecordBatch.from_arrays([ids, *lists], ["doc_id", "a", "b", "in_a", "in_b"])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, a array<int>, b array<int>, in_a array<int>, in_b array<int>")


def _batches(docs: DataFrame, a: ByteLevel, b: Codec, entries: int, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((a, b))
    wide = len(b.at) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = _digits(max(len(shared.value[0].at), wide))
        task, nth, batch = TaskContext.get().partitionId(), 0, _Batch()
        for ids, x in _blocks(batches, *shared.value):
            batch.add(ids, x, wide, digits)
            if batch.size >= entries:
                yield from batch.tables(task << 32 | nth)
                nth, batch = nth + 1, _Batch()
        if batch.columns:
            yield from batch.tables(task << 32 | nth)

    schema = f"batch long, doc_id {dict(docs.dtypes)['doc_id']}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, step array<int>, links array<long>, number int, pair long, df int"
    return docs.select("doc_id", text).mapInArrow(run, schema)


def _summed(left: pa.Table, right: pa.Table) -> pa.Table:
    """A batch's documents with the counts of its pairs summed over their links."""
    count, best = np.zeros(len(right), np.int64), np.zeros(len(right), np.int64)
    number = right["number"].to_numpy()
    count[number], best[number] = right["count"].to_numpy(), right["best"].to_numpy()
    left = left.combine_chunks()
    steps, links = (left[c].combine_chunks() if isinstance(left[c], pa.ChunkedArray) else left[c] for c in ("step", "links"))
    to = _offsets(pc.list_value_length(steps).to_numpy(zero_copy_only=False))
    step, n = steps.flatten().to_numpy().astype(np.int64), links.flatten().to_numpy()
    upto = _offsets(step)
    number = upto[1:] - np.repeat(upto[to[:-1]], np.diff(to))
    total = lambda v: np.diff(_offsets(n * v[number])[to])
    out = {c: left[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(out | {"n_best": pa.array(total(best), pa.int64()), "count_sum": pa.array(total(count), pa.int64()), "groups_sha256": left["groups_sha256"]})


def pair_counts(batches: DataFrame, wide: int) -> DataFrame:
    """pair, count (documents that hold it linked) and best (1 if the count is its A id's highest)."""
    counts = written(batches.filter("pair is not null").groupBy("pair").agg(F.sum("df").alias("count")), "pairs")
    a = F.expr(f"pair div {wide}L")
    highest = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    # one row for each id of A: bounded by its vocabulary
    return counts.withColumn("a", a).join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))


def align(docs: DataFrame, byte_level_path: str, model_path: str, entries: int = _ENTRIES, text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    ship(docs.sparkSession)
    a, b = load_byte_level(byte_level_path), load_codec(model_path)
    batches = written(_batches(docs, a, b, entries, text), "alignment")
    wide = len(b.at) - 1
    asked = batches.filter("pair is not null").select("batch", "number", "pair")
    answers = asked.join(pair_counts(batches, wide), "pair").select(F.col("batch").alias("of"), "number", "count", "best")
    own = batches.filter("pair is null").drop("number", "pair", "df")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return own.groupBy("batch").cogroup(answers.groupBy("of")).applyInArrow(_summed, schema)
