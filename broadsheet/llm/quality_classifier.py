"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight per hashed text feature is shared by all grades; ordered thresholds
cut the score into grades: P(grade <= k) = sigmoid(threshold[k] - score). The
grades are 0 toxic, 1 of low quality, 2 good. A document is kept if the tail
probability P(grade >= 2) reaches ``keep_at``.

The fit uses at most ``max_labelled`` labelled rows (those whose id has the least
hash), so the driver's memory is bounded; scoring covers every row.

Null text counts as empty. A text without words has only its shape features.
Labels that are null, or whose document is missing, are ignored; a document
rated twice counts twice. With no labels at all, or one grade only, every document is
kept. Repeated rows keep a row each; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .cluster import ship

_EDGE = np.zeros(256, bool)
_EDGE[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


_PREFIXES = (4, 6)


@dataclass(frozen=True)
class Fit:
    dims_log2: int = 18
    max_labelled: int = 10_000
    min_docs: int = 8
    l2: float = 0.3
    steps: int = 60
    keep_at: float = 0.5


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray


def features(block: words.Block, dims_log2: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each row as one ragged array, and its offsets."""
    row, n = block.row_of_word(), block.counts
    body = words.Block.__new__(words.Block)
    body.bytes, body.start, body.end = words._LOWER[block.bytes], block.start.copy(), block.end.copy()
    for _ in range(4):
        body.end -= _EDGE[block.bytes[body.end - 1]] & (body.end - body.start > 1)
        body.start += _EDGE[block.bytes[np.minimum(body.start, len(block.bytes) - 1)]] & (body.end - body.start > 1)
    word = body.hashes()
    starts = []
    for n_bytes in _PREFIXES:  # inflected forms share the beginning of the word
        long = np.flatnonzero(body.end - body.start > n_bytes)
        part = words.Block.__new__(words.Block)
        part.bytes, part.start = body.bytes, body.start[long]
        part.end = part.start + n_bytes
        starts.append((row[long], part.hashes() ^ np.uint64(0x2545F4914F6CDD1D)))
    body.start, body.end = body.end, block.end
    tail = body.hashes() ^ np.uint64(0x5851F42D4C957F2D)
    marks = body.end > body.start
    upper = np.concatenate(([0], np.cumsum(_UPPER[block.bytes])))
    shout = upper[block.end] - upper[block.start] >= 2
    grams = words.windows(word, 3)
    inside, to = words.starts_within(block.ptr, 3)
    distinct3 = _distinct(np.repeat(np.arange(block.rows), np.diff(to)), grams[inside], block.rows)
    full = np.maximum(n, 1)
    share = lambda x: np.minimum(9, 10 * x // full)
    shape = [
        share(np.bincount(row[marks], minlength=block.rows)),
        share(np.bincount(row[shout], minlength=block.rows)),
        np.minimum(9, 10 * distinct3 // np.maximum(np.diff(to), 1)),
        np.minimum(15, np.log2(full).astype(np.int64)),
    ]
    rows = [row, row[marks], *[r for r, _ in starts], *[np.arange(block.rows)] * len(shape)]
    codes = [word, tail[marks], *[c for _, c in starts], *[words.mix((s.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i)) for i, s in enumerate(shape)]]
    key = np.unique(np.concatenate(rows).astype(np.uint64) << np.uint64(dims_log2) | np.concatenate(codes) >> np.uint64(64 - dims_log2))
    return (key & np.uint64((1 << dims_log2) - 1)).astype(np.int64), np.searchsorted(key, np.arange(block.rows + 1, dtype=np.uint64) << np.uint64(dims_log2))


def _distinct(row: np.ndarray, code: np.ndarray, rows: int) -> np.ndarray:
    """Distinct codes by row; codes are folded to 40 bits below the row."""
    key = np.unique(row.astype(np.uint64) << np.uint64(40) | code >> np.uint64(24))
    return np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=rows)


def _sums(weights: np.ndarray, index: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    upto = np.concatenate(([0.0], np.cumsum(weights[index])))
    return upto[ptr[1:]] - upto[ptr[:-1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(index: np.ndarray, ptr: np.ndarray, grade: np.ndarray, grades: int, how: Fit) -> Model:
    """Maximum likelihood with an L2 penalty by L-BFGS. Thresholds are kept ordered by their logarithmic gaps."""
    dims = 1 << how.dims_log2
    seen = np.bincount(index, minlength=dims) >= how.min_docs
    columns = np.flatnonzero(seen)
    if not len(grade) or len(np.unique(grade)) < 2:
        return Model(np.zeros(dims), np.full(grades - 1, -np.inf))
    slot = np.cumsum(seen) - 1
    kept = seen[index]
    ptr = np.concatenate(([0], np.cumsum(kept)))[ptr]
    index, lengths, m = slot[index[kept]], np.diff(ptr), len(columns)

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, first, gaps = p[:m], p[m], p[m + 1 :]
        cut = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        low, high = np.append(-np.inf, cut)[grade], np.append(cut, np.inf)[grade]
        score = _sums(w, index, ptr)
        a, b = _sigmoid(low - score), _sigmoid(high - score)
        chance = np.maximum(b - a, 1e-12)
        da, db = a * (1 - a) / chance, b * (1 - b) / chance
        by_score = db - da
        g = np.empty_like(p)
        g[:m] = np.bincount(index, np.repeat(by_score, lengths), m) + how.l2 * w
        by_cut = np.array([np.sum(da[grade == k + 1]) - np.sum(db[grade == k]) for k in range(grades - 1)])
        g[m] = by_cut.sum()
        g[m + 1 :] = np.exp(gaps) * np.cumsum(by_cut[::-1])[::-1][1:]
        return float(-np.log(chance).sum() + 0.5 * how.l2 * (w @ w)), g

    p = np.zeros(m + grades - 1)
    p[m] = -1.0
    p = _lbfgs(loss, p, how.steps)
    weights = np.zeros(dims)
    weights[columns] = p[:m]
    return Model(weights, p[m] + np.concatenate(([0.0], np.cumsum(np.exp(p[m + 1 :])))))


def _lbfgs(loss, p: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    value, g = loss(p)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, used = -g, []
        for s, y, r in reversed(pairs):
            a = r * (s @ d)
            d = d - a * y
            used.append(a)
        if pairs:
            s, y, _ = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        else:
            d = d / max(1.0, np.linalg.norm(g))
        for (s, y, r), a in zip(pairs, reversed(used), strict=True):
            d = d + (a - r * (y @ d)) * s
        slope, step = g @ d, 1.0
        if slope >= 0:
            pairs.clear()
            d, slope = -g, -(g @ g)
        for _ in range(30):
            new, new_g = loss(p + step * d)
            if new <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = step * d, new_g - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y, 1 / (s @ y))][-memory:]
        done = value - new < 1e-7 * abs(value)
        p, value, g = p + s, new, new_g
        if done:
            break
    return p


def tails(score: np.ndarray, model: Model) -> np.ndarray:
    """P(grade >= k) for k from 1, one column each."""
    return 1 - _sigmoid(model.thresholds[None, :] - score[:, None])


def grade_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 0).when(quality == 0, 1).otherwise(2)


def train(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> Model:
    """Fit on the bounded sample. Only hashed features travel to the driver."""
    ship(docs.sparkSession)
    rated = labels.filter("quality is not null and toxic is not null and doc_id is not null").select(F.col("doc_id").alias("__id"), grade_of(F.col("quality"), F.col("toxic")).alias("__grade"))
    sample = rated.orderBy(F.xxhash64("__id"), "__id", "__grade").limit(how.max_labelled)
    chosen = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text")).join(F.broadcast(sample), "__id").select("__grade", "__text")
    dims = how.dims_log2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block in words.blocks(batch.column(1)):
                index, ptr = features(block, dims)
                out += [index[a:b].astype(np.int32).tobytes() for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(out, pa.binary())], ["grade", "features"])

    # several rows may bear a rated id; the bound holds for them too, and the same rows are taken each time
    rows = chosen.mapInArrow(run, "grade int, features binary").orderBy(F.xxhash64("features"), "grade").limit(how.max_labelled).toArrow()
    parts = [np.frombuffer(x, np.int32) for x in rows["features"].to_pylist()]
    ptr = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)
    index = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    return fit(index, ptr, rows["grade"].to_numpy().astype(np.int64), 3, how)


def judge(text: Column, docs: DataFrame, model: Model, how: Fit = Fit()) -> Column:
    """struct<expected_grade, p_grade1, p_grade2, kept> of a text column. The weights have a fixed size and are broadcast."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.thresholds))
    dims, keep_at = how.dims_log2, how.keep_at

    @F.arrow_udf("struct<expected_grade: double, p_grade1: double, p_grade2: double, kept: boolean>")
    def scored(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in column:
            scores = [np.zeros(0)]
            for block in words.blocks(texts):
                index, ptr = features(block, dims)
                scores.append(_sums(shared.value.weights.astype(np.float64, copy=False), index, ptr))
            p = tails(np.concatenate(scores), shared.value)
            fields = {"expected_grade": p.sum(1), "p_grade1": p[:, 0], "p_grade2": p[:, 1], "kept": p[:, 1] >= keep_at}
            yield pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], list(fields))

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> DataFrame:
    """doc_id, expected_grade, p_grade1, p_grade2 and kept for every row."""
    verdict = judge(F.col("text"), docs, train(docs, labels, how), how)
    return docs.select("doc_id", verdict.alias("v")).select("doc_id", "v.*")
