"""Token counts by rank-synchronous array merging.

A text is cut where no piece of the vocabulary can reach across: before a run of
spaces and around bytes that stand in no longer piece. The distinct units of a
batch are one ragged array of symbols; in each round every unit applies its
lowest-rank pair, all units at once, until no pair is left, and the surviving symbols are
counted (a character without a piece counts its bytes). Counts of units seen before come from a
fixed-size table.

Null text counts as empty: 0 bytes, 0 tokens. Texts of any length are counted
whole. Repeated rows keep a row each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import words
from .cluster import ship

_NONE = np.int64(1 << 62)
_SPACE_MARK = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """Pair keys left * size + right, sorted, with the piece that each makes and its rank."""

    digest: str
    size: int
    char_id: np.ndarray
    pairs: np.ndarray
    made: np.ndarray
    rank: np.ndarray
    lone: np.ndarray


def load_vocabulary(path: str) -> Vocabulary:
    """Read pieces and scores of a BPE model with byte fallback, the identity normaliser and a leading space mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ids = {model.id_to_piece(i): i for i in plain}
    by_score = sorted(plain, key=lambda i: (-model.get_score(i), i))
    place = {i: r for r, i in enumerate(by_score)}
    if any(a != _SPACE_MARK and b == _SPACE_MARK for p in ids for a, b in zip(p, p[1:], strict=False)):
        raise ValueError("a piece reaches across a space: units can't be cut there")
    char_id = np.full(0x110000, -1, np.int32)
    multi: set[str] = set()
    rows = []
    for p, i in ids.items():
        if len(p) == 1:
            char_id[ord(p)] = i
            continue
        multi.update(p)
        rows += [(ids[p[:k]] * n + ids[p[k:]], i, place[i]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
    char_id[0x20] = char_id[ord(_SPACE_MARK)]
    rows.sort()
    pairs, made, rank = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    lone = np.zeros(256, bool)
    lone[[b for b in range(128) if chr(b) not in multi and b != 0x20]] = True
    return Vocabulary(hashlib.sha256(Path(path).read_bytes()).hexdigest(), n, char_id, pairs, made, rank, lone)


def _symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece of each character of each unit, or minus its bytes; and the unit of each character."""
    lengths = ends - starts
    flat = data[words.spread(starts, lengths)]
    unit = np.repeat(np.arange(len(starts)), lengths)
    lead = np.flatnonzero((flat & 0xC0) != 0x80)
    size = np.diff(np.append(lead, len(flat)))
    first = flat[lead].astype(np.int64)
    point = np.where(size == 1, first, np.where(size == 2, first & 0x1F, np.where(size == 3, first & 0x0F, first & 0x07)))
    for k in (1, 2, 3):
        more = size > k
        point[more] = point[more] << 6 | (flat[lead[more] + k] & 0x3F)
    piece = v.char_id[point].astype(np.int64)
    return np.where(piece >= 0, piece, -size), unit[lead]


def _ranks(left: np.ndarray, right: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Rank and made piece of pairs; no pair: a rank above all."""
    key = left * v.size + right
    at = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
    found = (left >= 0) & (right >= 0) & (v.pairs[at] == key)
    return np.where(found, v.rank[at], _NONE), v.made[at]


def _occurrences(sym: np.ndarray, unit: np.ndarray, hits: np.ndarray, made: np.ndarray, best: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Of the pairs ``hits`` with their unit's lowest rank, those to merge in this round.

    All that don't overlap, from the left. But where a merge would make a pair with a
    better rank than its own, which would then come first, the unit merges its leftmost pair only.
    """
    order = np.arange(len(hits))
    run = np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(hits) != 1)), order, 0))
    hits = hits[(order - run) % 2 == 0]
    head = np.concatenate(([True], np.diff(unit[hits]) != 0))
    several = ~head
    several[:-1] |= ~head[1:]
    if not several.any():
        return hits
    c = hits[several]
    new = np.full(len(sym) + 3, -1, np.int64)  # merged symbols by the place of their left part
    new[c] = made[c]
    whose = np.concatenate((unit, [-1, -1, -1]))
    padded = np.concatenate((sym, [-1, -1, -1]))
    before = np.where(new[np.maximum(c - 2, 0)] >= 0, new[np.maximum(c - 2, 0)], padded[c - 1])
    before = np.where((c > 0) & (whose[c - 1] == unit[c]), before, -1)
    after = np.where(whose[c + 2] == unit[c], padded[c + 2], -1)
    after_new = np.where(whose[c + 2] == unit[c], new[c + 2], -1)
    least = np.minimum.reduce([_ranks(before, new[c], v)[0], _ranks(new[c], after, v)[0], _ranks(new[c], after_new, v)[0]])
    careful = np.unique(unit[c[least < best[c]]])
    return hits[head | ~np.isin(unit[hits], careful)] if len(careful) else hits


def merge_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Tokens of each unit data[start:end]."""
    out = np.zeros(len(starts), np.int64)
    if not len(starts):
        return out
    sym, unit = _symbols(data, starts, ends, v)
    while len(sym):
        rank, made = _ranks(sym[:-1], sym[1:], v)
        rank = np.append(np.where(unit[1:] == unit[:-1], rank, _NONE), _NONE)
        heads = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        best = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(sym))))
        live = best < _NONE
        done = ~live
        out += np.bincount(unit[done], np.where(sym[done] >= 0, 1, -sym[done]), len(out)).astype(np.int64)
        hits = np.flatnonzero(live & (rank == best))
        if not len(hits):
            break
        merge = _occurrences(sym, unit, hits, made, best, v)
        sym[merge] = made[merge]
        live[merge + 1] = False
        sym, unit = sym[live], unit[live]
    return out


class UnitCounter:
    """Counts by row, with a direct-mapped table of unit hashes; its size is fixed."""

    def __init__(self, v: Vocabulary, slots_log2: int = 20):
        self.v = v
        self.mask = np.uint64((1 << slots_log2) - 1)
        self.keys = np.zeros(1 << slots_log2, np.uint64)
        self.values = np.zeros(1 << slots_log2, np.uint32)

    def rows(self, column: pa.Array) -> np.ndarray:
        if pc.any(pc.match_substring(column, _SPACE_MARK)).as_py():
            column = pc.replace_substring(column, _SPACE_MARK, " ")
        data, offsets = words.buffers(column)
        out, at, n = np.zeros(len(offsets) - 1, np.int64), 0, len(offsets) - 1
        while at < n:
            to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 19), side="right")) - 1))
            out[at:to] = self._block(data[int(offsets[at]) : int(offsets[to])], offsets[at : to + 1] - offsets[at])
            at = to
        return out

    def _block(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        some = np.diff(offsets) > 0
        shifted = offsets + np.concatenate(([0], np.cumsum(some)))
        data = np.empty(len(raw) + int(some.sum()), np.uint8)
        mark = np.zeros(len(data), bool)
        mark[shifted[:-1][some]] = True
        data[mark], data[~mark] = 0x20, raw
        space, lone = data == 0x20, self.v.lone[data]
        begin = mark.copy()
        begin[1:] |= (space[1:] & ~space[:-1]) | lone[1:] | lone[:-1]
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))
        h = words.span_hashes(data, starts, ends) | np.uint64(1)
        slot = (h >> np.uint64(20)) & self.mask
        count = self.values[slot].astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != h)
        if len(miss):
            _, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            new = miss[first]
            fresh = merge_counts(data, starts[new], ends[new], self.v)
            count[miss] = fresh[back]
            self.keys[slot[new]], self.values[slot[new]] = h[new], fresh
        upto = np.concatenate(([0], np.cumsum(count)))
        row_at = np.searchsorted(starts, shifted)
        return np.diff(upto[row_at])


_counters: dict[str, UnitCounter] = {}


def _counter(v: Vocabulary) -> UnitCounter:
    if v.digest not in _counters:
        _counters.clear()
        _counters[v.digest] = UnitCounter(v)
    return _counters[v.digest]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit. The vocabulary's tables are bounded by its size and broadcast."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(load_vocabulary(model_path))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            n = pa.array(counter.rows(pc.fill_null(batch.column(1), "")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
