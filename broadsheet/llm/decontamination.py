"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of distinct five-word shingles into
classes [2^c, 2^(c+1)). For a class a document is seen through windows of 2^(c+2)
shingles, every 2^(c+1) shingles, so an item's passage lies in one window whole and
the window is at most four times its size: containment ``threshold`` then means a
Jaccard similarity of at least 0.8 / 4.2, however long the document is. Each of ``functions``
minima of each window is looked up among the items' minima of that function; one
hit makes a candidate. Items whose shingles stand in several pieces, wherever these are, become
candidates by their minima alone: the document holds each with a chance equal to the containment, and
a quarter of them is asked for (fewer than 20 of 80 at a containment of 0.8: a chance below 10^-20).
Windows and minima only propose: an item is contained if the whole document holds ``threshold`` of its distinct
shingles, which is counted exactly, so where its pieces stand and what stands between plays no part. An item
of one to four words is one shingle of its own length, found wherever its words stand in a row.

Items are dealt to blocks of about ``block_items`` items and ``block_bytes`` of text. Tasks
index one block each and write it as a file to the shared folder, which the workers map one after the other; every
block meets every document. Items without text, words or id match nothing. Ids may be numbers or
text. Null document text counts as empty, texts of any length are searched whole. Repeated items count
each; repeated documents keep a row each; an empty table on either side gives no
matches; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .cluster import new_folder, ship
from .elias_fano import read_arrays, write_arrays


@dataclass(frozen=True)
class Containment:
    shingle: int = 5
    threshold: float = 0.8
    functions: int = 80
    block_items: int = 20_000
    block_bytes: int = 32 << 20

    @property
    def least_minima(self) -> int:
        """Minima of an item that a document must hold somewhere."""
        return max(1, self.functions // 4)


_rng = np.random.default_rng(20240917)
_XOR = _rng.integers(0, 1 << 64, 1024, np.uint64)
_MULTIPLY = _rng.integers(0, 1 << 64, 1024, np.uint64) | np.uint64(1)
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Items:
    """Items of one block: ids, distinct shingles by item, the sorted minima with their items by class (a row a function), the shingles that are minima with their items and how many functions choose them, and short items by their number of words."""

    ids: pa.Array
    shingles: np.ndarray
    ptr: np.ndarray
    need: np.ndarray
    classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    signature: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def index_items(ids: pa.Array, texts: pa.Array, how: Containment) -> Items:
    sets: list[np.ndarray] = []
    by_length: dict[int, list[tuple[int, int]]] = {}
    for block in words.blocks(texts):
        h = block.hashes()
        inside, to = words.starts_within(block.ptr, how.shingle)
        code = words.windows(h, how.shingle)[inside] if len(inside) else np.zeros(0, np.uint64)
        sets += [np.unique(code[a:b]) for a, b in zip(to[:-1], to[1:], strict=True)]
        for r in np.flatnonzero((block.counts > 0) & (block.counts < how.shingle)).tolist():
            n = int(block.counts[r])
            by_length.setdefault(n, []).append((int(words.windows(h[block.ptr[r] : block.ptr[r + 1]], n)[0]), block.first + r))
    size = np.array([len(s) for s in sets], np.int64)
    level = np.where(size > 0, np.log2(np.maximum(size, 1)).astype(np.int64), -1)
    classes = {}
    for c in sorted(set(level[level >= 0].tolist())):
        of = np.flatnonzero(level == c)
        least = np.array([[((sets[i] ^ _XOR[f]) * _MULTIPLY[f]).min() for i in of] for f in range(how.functions)], np.uint64)
        order = np.argsort(least, axis=1)
        gate = np.zeros((how.functions, 1 << 16), bool)
        np.put_along_axis(gate, (least & np.uint64(0xFFFF)).astype(np.int64), True, axis=1)
        classes[c] = np.take_along_axis(least, order, 1), of[order], gate
    chosen, owner, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(size > 0).tolist():
        at, n = np.unique([((sets[i] ^ _XOR[f]) * _MULTIPLY[f]).argmin() for f in range(how.functions)], return_counts=True)
        chosen.append(sets[i][at])
        owner.append(np.full(len(at), i))
        times.append(n)
    chosen, owner, times = (np.concatenate(x) for x in (chosen, owner, times))
    order = np.argsort(chosen, kind="stable")
    passes = np.zeros(1 << min(24, max(16, (16 * len(chosen)).bit_length())), bool)
    passes[(chosen & np.uint64(len(passes) - 1)).astype(np.int64)] = True
    short = {n: (np.array([h for h, _ in sorted(x)], np.uint64), np.array([i for _, i in sorted(x)], np.int64)) for n, x in by_length.items()}
    need = np.ceil(how.threshold * size - 1e-9).astype(np.int64)
    return Items(ids, np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate(([0], np.cumsum(size))), need, classes, (chosen[order], owner[order], times[order], passes), short)


_SIGNATURE = ("shingle", "item", "times", "passes")


def write_items(path: str, items: Items) -> None:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", items.ids.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([items.ids], ["id"]))
    arrays = {"ids": np.frombuffer(sink.getvalue(), np.uint8), "shingles": items.shingles, "ptr": items.ptr, "need": items.need}
    for c, parts in items.classes.items():
        arrays |= {f"class {c} {name}": a.reshape(-1) for name, a in zip(("least", "item", "gate"), parts, strict=True)}
    arrays |= {f"signature {name}": a for name, a in zip(_SIGNATURE, items.signature, strict=True)}
    for n, parts in items.short.items():
        arrays |= {f"short {n} {name}": a for name, a in zip(("hash", "item"), parts, strict=True)}
    write_arrays(path, arrays)


def read_items(path: str, how: Containment) -> Items:
    a = read_arrays(path)
    numbers = lambda kind: sorted({int(name.split()[1]) for name in a if name.startswith(kind)})
    classes = {c: tuple(a[f"class {c} {name}"].reshape(how.functions, -1) for name in ("least", "item", "gate")) for c in numbers("class")}
    short = {n: (a[f"short {n} hash"], a[f"short {n} item"]) for n in numbers("short")}
    return Items(pa.ipc.open_stream(a["ids"].tobytes()).read_all()["id"].combine_chunks(), a["shingles"], a["ptr"], a["need"], classes, tuple(a[f"signature {name}"] for name in _SIGNATURE), short)


def _cells(to: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of cells of ``size`` entries that don't cross rows, and the row of each."""
    counts = -(-np.diff(to) // size)
    row = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return to[row] + nth * size, row


def _equal(wanted: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in values, in the sorted wanted) of all equal entries."""
    left, right = np.searchsorted(wanted, values, "left"), np.searchsorted(wanted, values, "right")
    some = np.flatnonzero(right > left)
    n = (right - left)[some]
    return np.repeat(some, n), words.spread(left[some], n)


def candidates(code: np.ndarray, to: np.ndarray, items: Items, how: Containment) -> list[tuple[int, int]]:
    """(row, item) in order, where a window of the row has a minimum in common with the item, or the row holds enough of the item's minima; code[to[r]:to[r+1]] are the shingles of row r."""
    if not len(code) or not len(items.ids):
        return []
    levels = {c: _cells(to, 2 << c) for c in items.classes}
    found: dict[int, list[np.ndarray]] = {c: [] for c in items.classes}
    n_items = len(items.ids)
    for f in range(how.functions):
        h = (code ^ _XOR[f]) * _MULTIPLY[f]
        for c, (least, item, gate) in items.classes.items():
            start, row = levels[c]
            low = np.minimum.reduceat(h, start)
            window = low.copy()
            window[:-1] = np.where(row[1:] == row[:-1], np.minimum(low[:-1], low[1:]), low[:-1])
            hit = np.flatnonzero(gate[f][(window & np.uint64(0xFFFF)).astype(np.int64)])
            of, at = _equal(least[f], window[hit])
            if len(of):
                found[c].append(hit[of] * n_items + item[f][at])
    pairs = [_scattered(code, to, items, how)]
    for c, keys in found.items():
        if keys:
            w, i = np.divmod(np.unique(np.concatenate(keys)), n_items)
            pairs.append(levels[c][1][w] * n_items + i)
    return [divmod(key, n_items) for key in np.unique(np.concatenate(pairs)).tolist()]


def _scattered(code: np.ndarray, to: np.ndarray, items: Items, how: Containment) -> np.ndarray:
    """row * items + item of the pairs where the row holds enough of the item's minima, wherever they stand."""
    shingle, item, times, passes = items.signature
    maybe = np.flatnonzero(passes[(code & np.uint64(len(passes) - 1)).astype(np.int64)])
    of, at = _equal(shingle, code[maybe])
    row = np.searchsorted(to, maybe[of], "right") - 1
    once = np.unique(row * len(shingle) + at)  # a shingle counts once in a row
    key, back = np.unique(once // len(shingle) * len(items.ids) + item[once % len(shingle)], return_inverse=True)
    return key[np.bincount(back, times[once % len(shingle)], len(key)) >= how.least_minima] if len(key) else key


def contained(block: words.Block, items: Items, how: Containment) -> list[dict[int, float]]:
    """For each row the items that it contains, with the exact share of their shingles."""
    hashes = block.hashes()
    inside, to = words.starts_within(block.ptr, how.shingle)
    code = words.windows(hashes, how.shingle)[inside] if len(inside) else np.zeros(0, np.uint64)
    out: list[dict[int, float]] = [{} for _ in range(block.rows)]
    last, own = None, code
    for r, i in candidates(code, to, items, how):
        if r != last:
            last, own = r, np.unique(code[to[r] : to[r + 1]])
        want = items.shingles[items.ptr[i] : items.ptr[i + 1]]
        hits = int((own[np.minimum(np.searchsorted(own, want), len(own) - 1)] == want).sum())
        if hits >= items.need[i]:
            out[r][i] = hits / len(want)
    for n, (wanted, item) in items.short.items():
        inside, to = words.starts_within(block.ptr, n)
        if len(inside):
            of, at = _equal(wanted, words.windows(hashes, n)[inside])
            for r, i in zip((np.searchsorted(to, of, "right") - 1).tolist(), item[at].tolist(), strict=True):
                out[r][i] = 1.0
    return out


def _item_files(benchmark: DataFrame, how: Containment) -> list[str]:
    """One index file for each block of items, made by the task that holds the block."""
    usable = benchmark.filter("item_id is not null and text is not null").select("item_id", "text")
    n, size = usable.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, math.ceil(n / how.block_items), math.ceil(size / how.block_bytes))
    folder = new_folder(benchmark.sparkSession, "items")

    def index(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by([("item_id", "ascending"), ("text", "ascending")]).combine_chunks()
        ids, texts = (pa.concat_arrays(rows[c].chunks) if rows[c].chunks else pa.array([], rows[c].type) for c in ("item_id", "text"))
        write_items(f"{folder}/{key[0].as_py()}", index_items(ids, texts, how))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32())})

    dealt = usable.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))
    made = dealt.repartition(parts, "part").groupBy("part").applyInArrow(index, "part int").toArrow()["part"].to_pylist()
    return [f"{folder}/{b}" for b in sorted(made)]


_held: dict[str, Items] = {}


def _items(path: str, how: Containment) -> Items:
    """The mapped block; a worker holds one."""
    if path not in _held:
        _held.clear()
        _held[path] = read_items(path, how)
    return _held[path]


def matches(text: Column, benchmark: DataFrame, how: Containment = Containment()) -> Column:
    """array<struct<item, share>> of the items contained in a text column."""
    ship(benchmark.sparkSession)
    files = _item_files(benchmark, how)
    kind = f"array<struct<item: {dict(benchmark.dtypes)['item_id']}, share: double>>"
    if not files:
        return F.array().cast(kind)

    @F.arrow_udf(kind)
    def found(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in column:
            row, ids, share = [np.zeros(0, np.int64)], [], [np.zeros(0)]
            for path in files:
                items = _items(path, how)
                hits = [(block.first + r, i, s) for block in words.blocks(texts) for r, x in enumerate(contained(block, items, how)) for i, s in x.items()]
                row.append(np.array([h[0] for h in hits], np.int64))
                ids.append(items.ids.take(pa.array([h[1] for h in hits], pa.int64())))
                share.append(np.array([h[2] for h in hits], float))
            rows = np.concatenate(row)
            order = np.argsort(rows, kind="stable")
            values = pa.StructArray.from_arrays([pa.concat_arrays(ids).take(pa.array(order)), pa.array(np.concatenate(share)[order])], ["item", "share"])
            yield pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[order], np.arange(len(texts) + 1)), pa.int32()), values)

    return F.sort_array(found(text))


def decontaminate(docs: DataFrame, benchmark: DataFrame, how: Containment = Containment()) -> DataFrame:
    """doc_id, n_items, items (ids joined by commas), best_share and contaminated."""
    found = docs.select("doc_id", matches(F.col("text"), benchmark, how).alias("m"))
    return found.select("doc_id", F.size("m").cast("long").alias("n_items"), F.array_join(F.transform("m", lambda x: x["item"].cast("string")), ",").alias("items"), F.coalesce(F.array_max(F.transform("m", lambda x: x["share"])), F.lit(0.0)).alias("best_share"), (F.size("m") > 0).alias("contaminated"))


def oracle(how: Containment = Containment()) -> str:
    """DuckDB: distinct shingles of whole documents, counted by item."""
    k, word = how.shingle, r"[^ \t\n\x0B\f\r]+"
    split = lambda id_, table: f"SELECT {id_}, row_number() OVER () AS r, regexp_extract_all(text, '{word}') AS w FROM {table} WHERE text IS NOT NULL"
    grams = lambda n: f"SELECT r, {n} AS k, i, array_to_string(w[i + 1:i + {n}], ' ') AS g FROM (SELECT r, w, unnest(range(0, len(w) - {n - 1})) AS i FROM d WHERE len(w) >= {n} AND {n} IN (SELECT k FROM q))"
    every = " UNION ALL ".join(grams(n) for n in range(1, k + 1))
    return f"""WITH b AS (SELECT * FROM ({split("item_id", "benchmark")}) WHERE item_id IS NOT NULL),
q AS (SELECT DISTINCT item_id, r, {k} AS k, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS g FROM b WHERE len(w) >= {k}
  UNION ALL SELECT item_id, r, len(w), array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND {k - 1}),
n AS (SELECT r AS item, any_value(item_id) AS item_id, count(*) AS n FROM q GROUP BY r),
d AS (SELECT * FROM ({split("doc_id", "documents")})),
hit AS (SELECT r, item, any_value(item_id) AS item_id, hits / any_value(n)::DOUBLE AS share FROM (SELECT d.r, q.r AS item, count(DISTINCT g) AS hits FROM ({every}) d JOIN q USING (k, g) GROUP BY d.r, q.r) JOIN n USING (item) GROUP BY r, item, hits HAVING hits >= ceil({how.threshold}::DOUBLE * any_value(n) - 1e-9)),
doc AS (SELECT doc_id, r FROM d UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL)
SELECT doc_id, count(item)::BIGINT AS n_items, coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY item_id), '') AS items, coalesce(max(share), 0.0)::DOUBLE AS best_share, count(item) > 0 AS contaminated
FROM (SELECT row_number() OVER () AS one, * FROM doc) doc LEFT JOIN hit USING (r) GROUP BY one, doc_id"""
