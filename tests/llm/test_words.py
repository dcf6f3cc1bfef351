"""Word kernels against plain Python."""

import numpy as np
import pyarrow as pa
from broadsheet.llm import elias_fano, near_dedup, substring_dedup, words
from hypothesis import given, settings
from hypothesis import strategies as st

from .conftest import words as plain

TEXT = st.text(alphabet=st.sampled_from("abB é \x1c\x0b\n\t  日😀"), max_size=40)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 60))
def test_words_and_hashes(texts, limit):
    found, hashes = [], {}
    for block in words.blocks(pa.array(texts, pa.string()), limit=limit):
        h = block.hashes()
        for r in range(block.rows):
            own = range(block.ptr[r], block.ptr[r + 1])
            found.append([bytes(block.bytes[block.start[i] : block.end[i]]).decode() for i in own])
            for i, w in zip(own, found[-1], strict=True):
                assert hashes.setdefault(w, h[i]) == h[i]
    assert found == [plain(t) for t in texts]
    assert len(set(hashes.values())) == len(hashes)


def thue_morse(n, flip=False):
    return "".join("ab"[(i.bit_count() & 1) ^ flip] for i in range(n))


def test_patterns_do_not_cancel_out():
    # a word of Thue-Morse letters and its complement have equal polynomials modulo 2**64 from 1,024 letters on
    texts = [thue_morse(n, flip) for n in (9, 1024, 2048, 4096) for flip in (False, True)]
    h = next(words.blocks(pa.array([" ".join(texts)]))).hashes()
    assert len(set(h.tolist())) == len(texts)
    runs = [np.array([3 if c == "a" else 7 for c in thue_morse(4096, flip)], np.uint64) for flip in (False, True)]
    assert words.windows(runs[0], 4096)[0] != words.windows(runs[1], 4096)[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 40))
def test_equal_windows_are_equal_runs(values, k):
    h = words.windows(words.mix(np.array(values, np.uint64)), k)
    runs = [tuple(values[i : i + k]) for i in range(len(values) - k + 1)]
    assert len(h) == len(runs) and len(set(zip(h.tolist(), runs, strict=True))) == len(set(h.tolist())) == len(set(runs))


def test_windows_agree_wherever_they_stand():
    one = words.windows(np.arange(50, dtype=np.uint64), 7)
    two = words.windows(np.arange(20, 90, dtype=np.uint64), 7)
    assert (one[20:] == two[: len(one) - 20]).all() and len(set(one.tolist())) == len(one)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 5000), max_size=300), st.sampled_from([1, 7, 1 << 20, 1 << 50]))
def test_elias_fano(values, scale):
    v = np.array(sorted(x * scale for x in values), np.uint64)
    e = elias_fano.EliasFano(elias_fano.encode(v, 5001 * scale))
    assert (e.find(v) == np.arange(len(v))).all()
    asked = np.arange(0, 5001 * scale, max(1, scale * 13 // 7), dtype=np.uint64)[:4000]
    assert ((e.find(asked) >= 0) == np.isin(asked, v)).all()


def test_arrays_in_files(tmp_path):
    a = {"x": np.arange(5, dtype=np.uint16), "y": np.zeros(0), "z": np.array([1, 1 << 60], np.uint64)}
    elias_fano.write_arrays(f"file://{tmp_path}/d/f", a)
    back = elias_fano.read_arrays(f"file://{tmp_path}/d/f")
    assert all((back[k] == a[k]).all() and back[k].dtype == a[k].dtype for k in a)


def test_packing():
    a = (np.array([1, 5, 1 << 63], np.uint64), np.array([-1, 4, 9], np.int64), np.array([3, 2, 1], np.int32))
    assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(substring_dedup.unpack(substring_dedup.pack(*a)), a, strict=True))


def test_labels_are_distinct_and_alignment_follows_order():
    t = words.mix(np.array([1, 2, 3, 4, 5] * 6 + [9, 8], np.uint64))
    code, to = near_dedup.labels(t, np.array([0, 30, 32]), 5)
    assert len(set(code[: to[1]].tolist())) == 26 and np.diff(to).tolist() == [26, 1]
    a = np.arange(100, dtype=np.uint64)
    assert near_dedup.alignment(a, a, 0.8) == 1
    assert near_dedup.alignment(a, np.delete(a, 50), 0.8) == 99 / 100
    assert near_dedup.alignment(a, np.roll(a, 50), 0.8) < 0.8
    assert near_dedup.alignment(a, a + np.uint64(1000), 0.8) == 0
