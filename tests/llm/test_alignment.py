"""Token groups and link counts against plain loops over the libraries' tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from broadsheet.llm import token_alignment
from tokenizers import Tokenizer

from .conftest import ODD, frame

A, B = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
PARTS = ["a", "e", "the", " ", "  ", "\n", "\n\n", "▁", "é", "日", "😀", "<0x0A>", "</s>", "<|endoftext|>", "0", "--", "==", "\x00", "\t", "ing", "́", "'s", "'LL", "ÿ", "\x85", "१२"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), token_alignment.load_byte_level(A)


def groups_of(text, libraries):
    a, b, level = libraries
    if not text:
        return []
    name = {i: t for t, i in level.ranks.items()}
    a_tokens = [(i, name[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
    b_tokens = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    if b"".join(t for _, t in a_tokens) != whole or b"".join(t for _, t in b_tokens) != whole:
        return []
    ends = lambda tokens: np.cumsum([len(t) for _, t in tokens]).tolist()
    a_ends, b_ends = ends(a_tokens), ends(b_tokens)
    out, low = [], 0
    for cut in sorted(set(a_ends) & set(b_ends)):
        out.append(tuple([i for (i, _), e in zip(tokens, to, strict=True) if low < e <= cut] for tokens, to in ((a_tokens, a_ends), (b_tokens, b_ends))))
        low = cut
    return out


def expected(rows, libraries):
    docs = [(i, groups_of(t, libraries)) for i, t in rows]
    links = [[(p, q) for a, b in g for p in a for q in b] for _, g in docs]
    held = Counter(pair for x in links for pair in set(x))
    most = {}
    for (p, _), n in held.items():
        most[p] = max(most.get(p, 0), n)
    text = lambda g: ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
    return [
        (i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(x), sum(held[y] == most[y[0]] for y in x), sum(held[y] for y in x), hashlib.sha256(text(g).encode()).hexdigest() if g else "")
        for (i, g), x in zip(docs, links, strict=True)
    ]


def test_random_texts_in_small_batches(spark, libraries):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices(PARTS, k=rng.randrange(50)))) for i in range(600)] + [(901, " " * 700 + "x" + " " * 699 + "\t" * 300), (902, "ab" * 300), (903, None)]
    got = token_alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B, entries=500)
    assert sorted(map(tuple, got.collect())) == sorted(expected(rows, libraries))


def test_odd_documents(spark, libraries):
    rows = [(i, t) for i, t, *_ in ODD if i != 8]
    got = token_alignment.align(frame(spark, [r for r in ODD if r[0] != 8], ["batch", "pair", "n_a"]), A, B)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected(rows, libraries), key=repr)
    assert token_alignment.align(frame(spark, ODD).limit(0), A, B).count() == 0
    assert token_alignment.align(frame(spark, ODD[:2]), A, B).count() == 2  # a batch without pairs


def test_large_groups_are_counted_by_distinct_ids():
    x = token_alignment.Aligned(np.array([7, 7, 9] * 40), np.array([3] * 50 + [4] * 50), np.array([120]), np.array([100]), np.array([0, 120]), np.array([0, 100]), np.array([0, 1]))
    row, pair, links = token_alignment.links_of(x, 10)
    assert (row.tolist(), pair.tolist(), links.tolist()) == ([0] * 4, [73, 74, 93, 94], [4000, 4000, 2000, 2000])


def test_groups_as_columns(spark, libraries):
    got = token_alignment.token_groups(spark.createDataFrame([(1, "naïve 日本 text"), (2, None)], "doc_id long, text string"), A, B).collect()
    want = groups_of("naïve 日本 text", libraries)
    assert [(r.a, r.b, r.in_a, r.in_b) for r in got] == [(sum((a for a, _ in want), []), sum((b for _, b in want), []), [len(a) for a, _ in want], [len(b) for _, b in want]), ([], [], [], [])]
