"""Elias-Fano sequences with vectorised successor search, and files that hold named arrays.

A sorted sequence of n integers below u keeps the low log2(u / n) bits of each in an
array and the high parts in unary: bit (high + i) is set for entry i, so the zeros are
monotone pointers: zero number h ends the entries with high part h.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Mapping

import numpy as np

_U = np.arange(256, dtype=np.uint64)
_FIVES, _THREES, _NIBBLES, _EACH, _TOPS = (np.uint64(b * 0x0101010101010101) for b in (0x55, 0x33, 0x0F, 0x01, 0x80))
#: Place of set bit number i of a byte, at byte * 8 + i.
_NTH = np.array([(bits + [0] * 8)[i] for byte in range(256) for bits in [[b for b in range(8) if byte >> b & 1]] for i in range(8)], np.uint64)


def local_path(uri: str) -> str | None:
    """The path of a file: URI, or None for another store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def write_arrays(uri: str, arrays: Mapping[str, np.ndarray]) -> int:
    """Write arrays to a shared store under their final name in one step; a repeated task writes the same again."""
    head, at, parts = {}, 0, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[name] = (a.dtype.str, len(a), at)
        parts += [a.tobytes(), b"\0" * (-a.nbytes % 8)]
        at += a.nbytes + -a.nbytes % 8
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    data = struct.pack("<q", len(text)) + text + b"".join(parts)
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(uri)
        other = f"{inner}.{uuid.uuid4().hex}"
        with store.open_output_stream(other) as out:
            out.write(data)
        store.move(other, inner)
    else:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        other = f"{path}.{uuid.uuid4().hex}"
        with open(other, "wb") as out:
            out.write(data)
        os.replace(other, path)
    return len(data)


def read_arrays(uri: str) -> dict[str, np.ndarray]:
    """Memory-mapped arrays of a file; from a store that can't be mapped they are read."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(uri)
        with store.open_input_file(inner) as f:
            data = np.frombuffer(f.readall(), np.uint8)
    else:
        data = np.asarray(np.memmap(path, np.uint8, "r"))
    (n,) = struct.unpack("<q", data[:8].tobytes())
    head = json.loads(data[8 : 8 + n].tobytes())
    return {name: data[8 + n + at : 8 + n + at + count * np.dtype(kind).itemsize].view(kind) for name, (kind, count, at) in head.items()}


def _low_kind(bits: int) -> type:
    return next(t for most, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if bits <= most)


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a sorted uint64 sequence without repeats, all below ``universe``."""
    n = len(values)
    low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
    high = (values >> np.uint64(low_bits)).astype(np.int64) if low_bits < 64 else np.zeros(n, np.int64)
    zeros = (int(high[-1]) if n else 0) + 1
    bits = np.zeros(-(-(n + zeros + 1) // 64) * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    bits[n + zeros :] = 1  # behind the last zero
    upper = np.packbits(bits, bitorder="little").view(np.uint64)
    before = np.concatenate(([0], np.cumsum(64 - np.bitwise_count(upper).astype(np.int64))))
    low = (values & np.uint64((1 << low_bits) - 1)).astype(_low_kind(low_bits)) if low_bits else np.zeros(0, np.uint8)
    kind = np.uint32 if n + zeros < 1 << 31 else np.int64
    return {"meta": np.array([n, low_bits, zeros], np.int64), "upper": upper, "before": before.astype(kind), "low": low}


class EliasFano:
    def __init__(self, arrays: Mapping[str, np.ndarray]):
        self.n, self.low_bits, self.zeros = (int(x) for x in arrays["meta"])
        self.upper, self.before, self.low = arrays["upper"], arrays["before"], arrays["low"]

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """Bit position of zero number k."""
        word = np.searchsorted(self.before, k.astype(self.before.dtype), "right") - 1
        left = (k - self.before[word]).astype(np.uint64)
        x = ~self.upper[word]
        # counts of set bits up to each byte, side by side in one word
        upto = x - ((x >> _U[1]) & _FIVES)
        upto = (upto & _THREES) + ((upto >> _U[2]) & _THREES)
        upto = ((upto + (upto >> _U[4])) & _NIBBLES) * _EACH
        byte = np.bitwise_count((left * _EACH | _TOPS) - upto & _TOPS).astype(np.uint64) * _U[8]
        left -= (upto << _U[8]) >> byte & _U[255]
        return word * 64 + (byte + _NTH[(x >> byte & _U[255]) << _U[3] | left]).astype(np.int64)

    def bounds(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First entry of each high part, which ascend, and the first after it: two pointers."""
        new = np.concatenate(([True], high[1:] != high[:-1]))
        part = high[new]
        at = np.cumsum(new) - 1
        last = self._select0(part) - part
        follows = np.concatenate(([False], part[1:] == part[:-1] + 1))
        first = np.empty_like(last)
        first[1:][follows[1:]] = last[:-1][follows[1:]]
        jump = np.flatnonzero(~follows)
        first[jump] = np.where(part[jump] > 0, self._select0(np.maximum(part[jump] - 1, 0)) - (part[jump] - 1), 0)
        return first[at], last[at]

    def _narrow(self, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The first entry of each range [first, last) whose low part isn't below that of the value."""
        want = (values & np.uint64((1 << self.low_bits) - 1)).astype(self.low.dtype)
        open_ = np.flatnonzero(first < last)
        at, last, want = first[open_], last[open_], want[open_]
        while len(open_):
            middle = (at + last) >> 1
            less = self.low[middle] < want
            at = np.where(less, middle + 1, at)
            last = np.where(less, last, middle)
            done = at >= last
            first[open_[done]] = at[done]
            go = ~done
            open_, at, last, want = open_[go], at[go], last[go], want[go]
        return first

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where it isn't there. The values ascend."""
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        inside = np.flatnonzero(high < self.zeros)
        out = np.full(len(values), -1, np.int64)
        if not len(inside) or not self.n:
            return out
        v = values[inside]
        first, end = self.bounds(high[inside])
        if self.low_bits:
            at = self._narrow(v, first, end)
            hit = at < end
            hit[hit] = self.low[at[hit]] == (v[hit] & np.uint64((1 << self.low_bits) - 1))
        else:
            at, hit = first, first < end
        out[inside[hit]] = at[hit]
        return out
