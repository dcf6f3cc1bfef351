"""Long candidates and texts: no recursion, time in proportion, and the windows of a plain count."""

import math
import random
import time
from collections import Counter

import pytest
from broadsheet.llm import secret_scan
from pyspark.sql import functions as F

from .conftest import frame

B64 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"


def windows(found, c):
    """First and last window at or above the limit, each counted anew."""
    hot = []
    for i in range(len(found) - c.window + 1):
        n = Counter(found[i : i + c.window]).values()
        if -sum(k / c.window * math.log2(k / c.window) for k in n) >= c.limit - 1e-9:
            hot.append(i)
    return (hot[0], hot[-1]) if hot else (None, None)


@pytest.mark.parametrize("c", secret_scan.CLASSES, ids=lambda c: c.kind)
def test_windows_by_brute_force(spark, monkeypatch, c):
    monkeypatch.setattr(secret_scan, "_CHARS", 37)  # many pieces
    rng = random.Random(5)
    letters = c.alphabet[:16]
    texts = ["".join(rng.choices(letters[: rng.randrange(1, 17)] if rng.random() < 0.5 else c.alphabet.replace("=", ""), k=rng.randrange(20, 200))) for _ in range(150)]
    texts += ["a" * 60 + "".join(rng.sample(letters, 16)) + "b" * 90 + "".join(rng.sample(letters, 16)) * 2 + "a" * 70]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", secret_scan._hot(F.col("t"), c).alias("h"))
    assert {r.i: (r.h.first, r.h.last) for r in df.collect()} == {i: windows(t, c) for i, t in enumerate(texts)}


def test_long_texts(spark):
    rng = random.Random(1)
    n = 1_000_000
    texts = {
        "base64": "".join(rng.choices(B64, k=n)),
        "numbers": "1-22-333-" * (n // 9),
        "camel": "camelCaseWordsAndMore" * (n // 21),
        "marks": "-" * n + "x9",
        "path": "/".join(map(str, range(100_000))),
        "assign": "token=abcdefgh " * (n // 15),
        "keys": " ".join("%032x" % rng.getrandbits(128) for _ in range(n // 33)),
    }
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts.values())]).repartition(4)
    began = time.time()
    got = {list(texts)[r["doc_id"]]: r for r in secret_scan.scan_secrets(docs).collect()}
    assert time.time() - began < 120
    assert got["base64"]["spans"] == f"entropy_base64:0:{n}"
    assert [got[k]["spans"] for k in ("numbers", "camel", "path")] == ["", "", ""]
    assert got["assign"]["n_assign"] == n // 15 and got["keys"]["n_hex"] == n // 33


def test_many_known_spans_hold_their_candidates(spark):
    key = "q8Zt3Lw9Xb5Rk1Vn7Hc4Yd6Mf2Gs0Jp8"
    text = " ".join(f"token={key[i % 7 :]}x {key[i % 5 :]}" for i in range(700))
    r = secret_scan.scan_secrets(frame(spark, [(1, text, "en", "s")])).collect()[0]
    spans = [s.split(":") for s in r["spans"].split(",")]
    assert r["n_assign"] == 700 and r["n_entropy"] == 700
    assert [k for k, *_ in spans] == ["assign", "entropy_base64"] * 700
    assert all(int(a[2]) <= int(b[1]) for a, b in zip(spans, spans[1:], strict=False))
