"""Exact substring deduplication with difference-cover anchors.

A window is ``window`` consecutive words. Shorter windows of window - period + 1
words are hashed only where the position in the document, modulo ``period``, is in a difference
cover: for any two residues i and j some shift d < period puts both i + d and
j + d into the cover, so two equal windows always share an anchor at the same shift.

1. Anchors whose hash occurs twice anywhere are found.
2. From each of them the windows that reach over it are extended to full length
   and hashed to 128 bits from two independent hashes of each word; those that occur twice are repeats.
3. Every word under a repeated window is removed.

Hashes travel in packed arrays, one for each task and hash range. A hash that a task sees
more than once is known as repeated there and sent once for the others, so a
passage in a third of all documents costs one record a task. Positions come back
to their rows by row number.

Null text counts as empty. A document shorter than the window loses nothing.
Repeated rows are repeats of each other; every row keeps its row. Texts are processed
whole. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .cluster import hadoop_size, new_folder, ship, shuffle_cleanup, written


@dataclass(frozen=True)
class Repeats:
    window: int = 35
    period: int = 21
    cover: tuple[int, ...] = (0, 1, 4, 14, 16)
    flush: int = 2_000_000
    shard_bytes: int = 8 << 20

    def __post_init__(self) -> None:
        if {(a - b) % self.period for a in self.cover for b in self.cover} != set(range(self.period)):
            raise ValueError("the positions are no difference cover of the period")
        if not 0 < self.period <= self.window:
            raise ValueError("the period must not exceed the window")

    @property
    def anchor(self) -> int:
        return self.window - self.period + 1


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as byte planes, compressed. A sorted first array is stored as differences."""
    n, parts = len(arrays[0]), []
    for i, a in enumerate(arrays):
        a = np.ascontiguousarray(np.diff(a, prepend=a.dtype.type(0)) if i == 0 else a)
        parts.append(a.dtype.str.encode().ljust(4) + a.view(np.uint8).reshape(n, a.itemsize).T.tobytes())
    return struct.pack("<qB", n, len(arrays)) + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    n, count = struct.unpack_from("<qB", data)
    flat, at, out = zstandard.ZstdDecompressor().decompress(data[9:]), 0, []
    for i in range(count):
        kind = np.dtype(flat[at : at + 4].decode().strip())
        planes = np.frombuffer(flat, np.uint8, n * kind.itemsize, at + 4).reshape(kind.itemsize, n)
        a = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
        out.append(np.cumsum(a, dtype=kind) if i == 0 else a)
        at += 4 + n * kind.itemsize
    return out


_SCHEMA = "part int, kind int, data binary"
_FIELDS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
_HASHES, _MARKS = 0, 1
_SECOND = 0x8EBC6AF09C88C6E3


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _FIELDS.types, strict=True)], schema=_FIELDS)


def _split(part: np.ndarray, kind: int, *arrays: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Arrays ordered by ``part``, packed for each part."""
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, np.int64)
    return [(int(part[a]), kind, pack(*(x[a:b] for x in arrays))) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _marks(row: np.ndarray, at: np.ndarray, parts: int) -> list[tuple[int, int, bytes]]:
    part = (words.mix(row.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((at, row, part))
    return _split(part[order], _MARKS, row[order], at[order])


def _in_order(h: np.ndarray, check: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """Arrays ordered by (h, check), and whether each entry is equal to the next."""
    order = np.argsort(h)
    tie = h[order][1:] == h[order][:-1]
    if (tie & (check[order][1:] != check[order][:-1])).any():
        order = np.lexsort((check, h))
    h, check = h[order], check[order]
    again = np.concatenate(((h[1:] == h[:-1]) & (check[1:] == check[:-1]), [False]))
    return h, check, *[x[order] for x in others], again


def _sent(h: np.ndarray, check: np.ndarray, row: np.ndarray, at: np.ndarray, parts: int) -> list[tuple[int, int, bytes]]:
    """Hashes seen once with their place, hashes seen more often once and without one (row -1), and the places of the latter as marks."""
    h, check, row, at, again = _in_order(h, check, row, at)
    many = again | np.concatenate(([False], again[:-1]))
    first = ~np.concatenate(([False], again[:-1]))
    part = ((h[first] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    return _split(part, _HASHES, h[first], check[first], np.where(many, -1, row)[first], at[first]) + _marks(row[many], at[many], parts)


def _hashed(produce: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]], parts: int, flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for found in produce(batch):
                held.append(found)
                size += len(found[0])
                if size >= flush:
                    yield _batch(_sent(*map(np.concatenate, zip(*held, strict=True)), parts))
                    held, size = [], 0
        if size:
            yield _batch(_sent(*map(np.concatenate, zip(*held, strict=True)), parts))

    return run


def _repeated(parts: int):
    """Of one hash range: the places whose hash occurs twice; marks pass through."""

    def run(table: pa.Table) -> pa.Table:
        rows = [(k.as_py(), d.as_py()) for k, d in zip(table["kind"], table["data"], strict=True)]
        marks = [tuple(unpack(d)) for k, d in rows if k == _MARKS]
        groups = [tuple(unpack(d)) for k, d in rows if k == _HASHES]
        if groups:
            _, _, row, at, again = _in_order(*map(np.concatenate, zip(*groups, strict=True)))
            hit = (again | np.concatenate(([False], again[:-1]))) & (row >= 0)
            marks.append((row[hit], at[hit]))
        if not marks:
            return _FIELDS.empty_table()
        out = _marks(*map(np.concatenate, zip(*marks, strict=True)), parts)
        return pa.Table.from_batches([_batch(out)]) if out else _FIELDS.empty_table()

    return run


_PLACES = pa.schema([("row", pa.int64()), ("places", pa.binary())])


def _by_row(table: pa.Table) -> pa.Table:
    marks = [unpack(d.as_py()) for d in table["data"]]
    row, at = map(np.concatenate, zip(*marks, strict=True))
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    edges = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1], [True]))) if len(row) else np.zeros(1, np.int64)
    return pa.Table.from_arrays([pa.array(row[edges[:-1]], pa.int64()), pa.array([at[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], schema=_PLACES)


def repeated_places(source: DataFrame, produce, parts: int, flush: int, tag: str) -> DataFrame:
    """(row, places) of the hashes that occur twice; ``produce`` maps a batch to hashes, second hashes, rows and places."""
    sent = source.mapInArrow(_hashed(produce, parts, flush), _SCHEMA)
    found = sent.groupBy("part").applyInArrow(_repeated(parts), _SCHEMA)
    return written(found.groupBy("part").applyInArrow(_by_row, "row long, places binary"), tag)


def _ranges(batch: pa.RecordBatch, column: int) -> Iterator[tuple[words.Block, np.ndarray, slice]]:
    row = batch.column(0).to_numpy()
    for block in words.blocks(batch.column(column)):
        yield block, row[block.first : block.first + block.rows], slice(block.first, block.first + block.rows)


def _anchors(how: Repeats):
    cover = np.zeros(how.period, bool)
    cover[list(how.cover)] = True

    def produce(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for block, row, _ in _ranges(batch, 1):
            inside, to = words.starts_within(block.ptr, how.anchor)
            of = np.repeat(np.arange(block.rows), np.diff(to))
            at = inside - block.ptr[of]
            use = cover[at % how.period] & (block.counts[of] >= how.window)
            # an anchor only proposes windows: it needs no second hash
            yield words.windows(block.hashes(), how.anchor)[inside[use]], np.zeros(int(use.sum()), np.uint8), row[of[use]], at[use].astype(np.int32)

    return produce


def _covered(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether each of n positions lies in one of the ranges [first, last)."""
    edge = np.bincount(first, minlength=n + 1) - np.bincount(last, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _flat_places(places: pa.Array, block: words.Block, here: slice) -> tuple[np.ndarray, np.ndarray]:
    """Places of a block's rows as positions in the block, and the row of each."""
    parts = [np.frombuffer(x, np.int32) if x else np.zeros(0, np.int32) for x in places[here].to_pylist()]
    of = np.repeat(np.arange(block.rows), [len(x) for x in parts])
    return np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int64) + block.ptr[of], of


def _extended(how: Repeats):
    def produce(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for block, row, here in _ranges(batch, 1):
            anchor, of = _flat_places(batch.column(2), block, here)
            first = np.maximum(anchor - (how.period - 1), block.ptr[of])
            last = np.minimum(anchor, block.ptr[of + 1] - how.window) + 1
            use = last > first
            start = np.flatnonzero(_covered(len(block.start), first[use], last[use]))
            mine = np.searchsorted(block.ptr, start, "right") - 1
            one, two = (words.windows(block.hashes(seed), how.window)[start] if len(start) else np.zeros(0, np.uint64) for seed in (0, _SECOND))
            yield one, two, row[mine], (start - block.ptr[mine]).astype(np.int32)

    return produce


def kept_words(block: words.Block, gone: np.ndarray) -> list[bytes]:
    """The words of each row that stay, joined by one space."""
    stay = np.flatnonzero(~gone)
    length = block.end[stay] - block.start[stay] + 1
    padded = np.append(block.bytes, np.uint8(0x20))
    flat = padded[words.spread(block.start[stay], length)]
    to = np.cumsum(length)
    flat[to - 1] = 0x20
    to = np.concatenate(([0], to))[np.searchsorted(stay, block.ptr)]
    data = flat.tobytes()
    return [data[a : max(a, b - 1)] for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]


def oracle(how: Repeats = Repeats()) -> str:
    """DuckDB: windows as joined words, counted over all documents."""
    k = how.window
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - {k - 2})) AS i FROM d WHERE len(w) >= {k}),
g AS (SELECT s.r, i, sha256(array_to_string(w[i:i + {k - 1}], ' ')) AS g FROM s JOIN d USING (r)),
twice AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {k})) AS p FROM g SEMI JOIN twice USING (g)),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""


def remove_repeats(docs: DataFrame, how: Repeats = Repeats(), texts: bool = False, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row; with ``texts`` also kept_text."""
    spark = docs.sparkSession
    ship(spark)
    path = new_folder(spark, "repeat-rows")
    numbered = docs.select("doc_id", F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    with shuffle_cleanup(spark):
        numbered.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(numbered.schema).parquet(path)
    parts = max(8, math.ceil(hadoop_size(spark, path) / how.shard_bytes))
    anchors = repeated_places(rows.select("row", "text"), _anchors(how), parts, how.flush, "repeat-anchors")
    near = rows.select("row", "text").join(anchors, "row").select("row", "text", "places")
    repeats = repeated_places(near, _extended(how), parts, how.flush, "repeat-windows")
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * texts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_, removed, digest, kept = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], []
            for block, _, here in _ranges(batch, 1):
                start, _ = _flat_places(batch.column(2), block, here)
                gone = _covered(len(block.start), start, start + how.window)
                left = kept_words(block, gone)
                digest += [hashlib.sha256(x).hexdigest() for x in left]
                kept += [x.decode() for x in left] if texts else []
                words_.append(block.counts)
                removed.append(np.diff(np.concatenate(([0], np.cumsum(gone)))[block.ptr]))
            columns = [batch.column(3), pa.array(np.concatenate(words_)), pa.array(np.concatenate(removed)), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.string())] * texts, names)

    return rows.join(repeats, "row", "left").select("row", "text", "places", "doc_id").mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)
