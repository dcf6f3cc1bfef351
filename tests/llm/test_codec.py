"""Encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from broadsheet.llm import piece_codec

from .conftest import ODD, frame

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
PARTS = ["a", "e", "the", " ", "  ", "\n", "▁", "é", "日", "😀", "<0x0A>", "</s>", "<s>", "0", "1", "--", "\x00", "\t", "ing", "́", "don", "ÿ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return piece_codec.load_codec(PATH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_random_texts_through_a_pool_that_overflows(library, codec):
    rng = random.Random(1)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(60))) for _ in range(1500)] + ["", " ", "▁", " a", "a ", " " * 50 + "x", "ab" * 3000]
    encoder = piece_codec.Encoder(codec, slots_log2=10, pool=1 << 11)
    seen = 0
    for first, ids, ptr in encoder.blocks(pa.array(texts), limit=4000):
        texts_back = piece_codec.decoded(ids, ptr, codec).to_pylist()
        for r in range(len(ptr) - 1):
            want = library.encode(texts[first + r])
            assert ids[ptr[r] : ptr[r + 1]].tolist() == want
            assert texts_back[r] == library.decode(want)
            seen += 1
    assert seen == len(texts)


def test_random_ids_decode_as_the_library_does(library, codec):
    rng = random.Random(2)
    lists = [[rng.choice([0, 1, 2, 3 + rng.randrange(256), rng.randrange(32000), 29871]) for _ in range(rng.randrange(9))] for _ in range(5000)]
    ptr = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    assert piece_codec.decoded(np.array(sum(lists, []), np.int64), ptr, codec).to_pylist() == [library.decode(x) for x in lists]


def test_query_on_odd_documents(spark, library):
    got = sorted(map(tuple, piece_codec.encode_digests(frame(spark, ODD, ["ids", "n_tokens", "decoded"]), PATH).collect()), key=repr)
    ids = {i: library.encode(t or "") + [2] for i, (_, t, *_) in enumerate(ODD)}
    want = [(ODD[i][0], len(x), sha(" ".join(map(str, x))), sha(library.decode(x))) for i, x in ids.items()]
    assert got == sorted(want, key=repr)
    assert piece_codec.encode_digests(frame(spark, ODD).limit(0), PATH).count() == 0


def test_round_trip_of_whole_documents(spark, documents, library):
    encoded = piece_codec.encode(documents, PATH, end=False)
    back = {r.doc_id: r.text for r in piece_codec.decode(encoded, PATH).collect()}
    for r in documents.collect():
        assert back[r.doc_id] == (r.text or "").replace("▁", " ")
    lists = spark.createDataFrame([(1, None), (2, [None, 15043])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in piece_codec.decode(lists, PATH).collect()} == {1: "", 2: library.decode([15043])}
