"""SentencePiece encoding and decoding by vectorised merge rounds.

Encoding: texts are cut into units where no piece of the vocabulary reaches across. The
distinct units of a block are flat arrays of symbols (piece, unit, place of its first byte). In each
round every unit takes its lowest-rank pair (a segmented minimum), merges all its occurrences
from the left at once, and the arrays are compacted, until no pair is left; where a merge
would make a better pair, only the leftmost occurrence is merged, so the order of the
library's queue is kept. Characters without a piece become byte pieces. The ids of units seen
before come from a pool of fixed size.

Decoding: the bytes of all pieces of a block are gathered at once; the first space mark of a row goes,
control pieces give nothing, and bytes that are no UTF-8 become U+FFFD each.

Null and empty texts have no pieces (the end id alone, if it is asked for) and decode to the empty
text. Texts of any length are taken whole, in blocks of rows; a long text is a block of its own. Repeated
rows keep a row each; an empty table gives an empty result; other columns are ignored.
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
from pyspark.sql import functions as F

from . import words
from .cluster import ship
from .token_counts import _NONE, _SPACE_MARK, Vocabulary, _occurrences, _ranks, _symbols, load_vocabulary

_BLOCK = 1 << 19


@dataclass(frozen=True)
class Codec:
    """A vocabulary with the pieces of single bytes, the end id, and the bytes that each id decodes to (surface[at[i]:at[i + 1]])."""

    vocabulary: Vocabulary
    digest: str
    byte_id: np.ndarray
    end: int
    surface: np.ndarray
    at: np.ndarray
    is_byte: np.ndarray
    marked: np.ndarray


def load_codec(path: str) -> Codec:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    is_byte = np.array([model.is_byte(i) for i in range(n)])
    byte_id = np.zeros(256, np.int64)
    texts, marked = [], np.zeros(n, bool)
    for i, p in enumerate(pieces):
        if is_byte[i]:
            byte_id[int(p[3:5], 16)] = i
            texts.append(bytes([int(p[3:5], 16)]))
        elif model.is_control(i):
            texts.append(b"")
        elif model.is_unknown(i):
            texts.append(" ⁇ ".encode())
        else:
            texts.append(p.replace(_SPACE_MARK, " ").encode())
            marked[i] = p.startswith(_SPACE_MARK)
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    digest = hashlib.sha256(Path(path).read_bytes()).hexdigest()
    return Codec(load_vocabulary(path), digest, byte_id, model.eos_id(), np.frombuffer(b"".join(texts), np.uint8), at, is_byte, marked)


def merged(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, c: Codec) -> tuple[np.ndarray, np.ndarray]:
    """The ids of units data[start:end] one after the other, and the n + 1 offsets of that list."""
    v, n = c.vocabulary, len(starts)
    if not n:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    sym, unit = _symbols(data, starts, ends, v)
    at = words.spread(starts, ends - starts)
    at = at[(data[at] & 0xC0) != 0x80]
    left: list[tuple[np.ndarray, ...]] = []
    while len(sym):
        rank, made = _ranks(sym[:-1], sym[1:], v)
        rank = np.append(np.where(unit[1:] == unit[:-1], rank, _NONE), _NONE)
        heads = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        best = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(sym))))
        live = best < _NONE
        left.append((sym[~live], unit[~live], at[~live]))
        hits = np.flatnonzero(live & (rank == best))
        if not len(hits):
            break
        merge = _occurrences(sym, unit, hits, made, best, v)
        sym[merge] = made[merge]
        live[merge + 1] = False
        sym, unit, at = sym[live], unit[live], at[live]
    sym, unit, at = (np.concatenate(x) for x in zip(*left, strict=True))
    order = np.argsort(unit, kind="stable")
    sym, unit, at = sym[order], unit[order], at[order]
    width = np.where(sym >= 0, 1, -sym)
    ids = np.repeat(sym, width)
    raw = ids < 0
    ids[raw] = c.byte_id[data[words.spread(at, width)[raw]]]
    return ids.astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(unit, width, n).astype(np.int64))))


class Encoder:
    """Ids by row. A direct-mapped table of unit hashes points into a pool of ids; both have a fixed size."""

    def __init__(self, codec: Codec, slots_log2: int = 20, pool: int = 1 << 22):
        self.codec = codec
        self.mask = np.uint64((1 << slots_log2) - 1)
        self.keys = np.zeros(1 << slots_log2, np.uint64)
        self.first = np.zeros(1 << slots_log2, np.int64)
        self.count = np.zeros(1 << slots_log2, np.int64)
        self.pool = np.zeros(pool, np.int32)
        self.used = 0

    def blocks(self, column: pa.Array, limit: int = _BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, n + 1 offsets) of blocks of consecutive rows of about ``limit`` bytes."""
        if pc.any(pc.match_substring(column, _SPACE_MARK)).as_py():
            column = pc.replace_substring(column, _SPACE_MARK, " ")
        data, offsets = words.buffers(column)
        at, n = 0, len(offsets) - 1
        while at < n:
            to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1))
            yield at, *self._block(data[int(offsets[at]) : int(offsets[to])], offsets[at : to + 1] - offsets[at])
            at = to

    def _block(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lone = self.codec.vocabulary.lone
        some = np.diff(offsets) > 0
        shifted = offsets + np.concatenate(([0], np.cumsum(some)))  # each text with a space before it
        data = np.empty(int(shifted[-1]), np.uint8)
        begin = np.zeros(len(data), bool)
        begin[shifted[:-1][some]] = True
        data[begin], data[~begin] = 0x20, raw
        space, alone = data == 0x20, lone[data]
        begin[1:] |= (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        starts = np.flatnonzero(begin)
        ids, first, count = self._units(data, starts, np.append(starts[1:], len(data)))
        upto = np.concatenate(([0], np.cumsum(count)))
        return ids[words.spread(first, count)], upto[np.searchsorted(starts, shifted)]

    def _units(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A list of ids, and where in it each unit's ids begin and how many they are."""
        h = words.span_hashes(data, starts, ends) | np.uint64(1)
        slot = (h >> np.uint64(20)) & self.mask
        known = self.keys[slot] == h
        first, count = self.first[slot], self.count[slot]
        miss = np.flatnonzero(~known)
        if not len(miss):
            return self.pool, first, count
        _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
        new = miss[one]
        ids, ptr = merged(data, starts[new], ends[new], self.codec)
        if self.used + len(ids) > len(self.pool):  # a full pool begins anew
            self.keys[:], self.used = 0, 0
            if known.any() or len(ids) > len(self.pool):
                _, one, back = np.unique(h, return_index=True, return_inverse=True)
                ids, ptr = merged(data, starts[one], ends[one], self.codec)
                return ids, ptr[:-1][back], np.diff(ptr)[back]
        at = self.used + ptr[:-1]
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.keys[slot[new]], self.first[slot[new]], self.count[slot[new]] = h[new], at, np.diff(ptr)
        first[miss], count[miss] = at[back], np.diff(ptr)[back]
        return self.pool, first, count


def with_end(ids: np.ndarray, ptr: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Every row's ids with the end id behind them."""
    to = ptr + np.arange(len(ptr))
    out = np.empty(int(to[-1]), ids.dtype)
    closing = np.zeros(len(out), bool)
    closing[to[1:] - 1] = True
    out[closing], out[~closing] = end, ids
    return out, to


def _text_of(ids: list[int], c: Codec) -> str:
    """One row with bytes that are no UTF-8: in a run of byte pieces each such byte gives U+FFFD."""
    out, run, begun = [], b"", False
    for i in [*ids, None]:
        if i is not None and c.is_byte[i]:
            run += c.surface[c.at[i] : c.at[i + 1]].tobytes()
            continue
        while run:
            for k in range(1, 5):
                try:
                    out.append(run[:k].decode())
                    run = run[k:]
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                run = run[1:]
            begun = True
        if i is not None and c.at[i] < c.at[i + 1]:
            text = c.surface[c.at[i] : c.at[i + 1]].tobytes().decode()
            out.append(text[1:] if c.marked[i] and not begun else text)
            begun = True
    return "".join(out)


def decoded(ids: np.ndarray, ptr: np.ndarray, c: Codec) -> pa.Array:
    """The text of each row ids[ptr[r]:ptr[r + 1]]."""
    width = c.at[ids + 1] - c.at[ids]
    data = c.surface[words.spread(c.at[ids], width)]
    upto = np.concatenate(([0], np.cumsum(width)))
    offsets = upto[ptr]
    shown = np.append(np.flatnonzero(width > 0), len(ids))  # the first piece of a row that has bytes loses its space mark
    first = shown[np.minimum(np.searchsorted(shown, ptr[:-1]), len(shown) - 1)]
    strips = first < ptr[1:]
    strips[strips] = c.marked[ids[first[strips]]]
    keep = np.ones(len(data), bool)
    keep[offsets[:-1][strips]] = False
    data = data[keep]
    offsets = offsets - np.concatenate(([0], np.cumsum(strips)))
    rows = pa.Array.from_buffers(pa.large_binary(), len(ptr) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    try:
        return rows.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([_text_of(ids[a:b].tolist(), c) for a, b in zip(ptr[:-1], ptr[1:], strict=True)], pa.large_string())


_encoders: dict[str, Encoder] = {}


def encoder_of(c: Codec) -> Encoder:
    """The worker's encoder; it holds one."""
    if c.digest not in _encoders:
        _encoders.clear()
        _encoders[c.digest] = Encoder(c)
    return _encoders[c.digest]


def _lists(ids: np.ndarray, ptr: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, model_path: str, end: bool = True, text: str = "text", decode_too: bool = False) -> DataFrame:
    """doc_id, ids (array<int>), and with ``decode_too`` the text that the ids decode to. The codec's tables are bounded by the vocabulary and broadcast."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(load_codec(model_path))
    names = ["doc_id", "ids", *["decoded"] * decode_too]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        encoder = encoder_of(c)
        for batch in batches:
            for first, ids, ptr in encoder.blocks(pc.fill_null(batch.column(1), "")):
                if end:
                    ids, ptr = with_end(ids, ptr, c.end)
                columns = [batch.column(0).slice(first, len(ptr) - 1), _lists(ids, ptr)]
                if decode_too:
                    columns.append(decoded(ids, ptr, c).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>" + ", decoded string" * decode_too)


def decode(encoded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """doc_id and the text of each list of ids; a null list gives the empty text, a null within a list nothing."""
    spark = encoded.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(load_codec(model_path))
    known = F.coalesce(F.filter(F.col(ids), lambda x: x.isNotNull()), F.array().cast("array<int>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ptr = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False)[ptr[0] : ptr[-1]] if len(lists) else np.zeros(0, np.int32)
            texts = decoded(flat.astype(np.int64), ptr - ptr[0], shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), texts.cast(pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", known.alias("ids")).mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, with an end id."""
    coded = encode(docs, model_path, decode_too=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
