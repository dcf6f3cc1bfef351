"""Methods against slow, plain accounts of themselves: order, features, windows of entropy."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from broadsheet.llm import near_dedup, quality_classifier, secret_scan
from pyspark.sql import functions as F

from .conftest import ODD, SF, frame, words

# near duplicates: the order of labels counts


def labels_in_order(text, k=5):
    w, seen, out = words(text), Counter(), []
    grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def common_in_order(a, b):
    """Longest common subsequence of two sequences without repeats, by the quadratic recurrence over the places in b."""
    place = {x: i for i, x in enumerate(b)}
    at = [place[x] for x in a if x in place]
    best = []
    for i, x in enumerate(at):
        best.append(1 + max((best[j] for j in range(i) if at[j] < x), default=0))
    return max(best, default=0)


def pairs_by_force(texts, threshold=0.8):
    """Pairs of different word sequences that are similar enough in order; the overlap of the sets only rules out."""
    own = [labels_in_order(t) for t in texts]
    sets = [set(x) for x in own]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    overlap = Counter(p for h in holders.values() for p in combinations(h, 2))
    out = []
    for (a, b), n in overlap.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) and words(texts[a]) != words(texts[b]):
            m = common_in_order(own[a], own[b])
            if m >= threshold * (len(own[a]) + len(own[b]) - m) - 1e-9:
                out.append((a, b))
    return out


def test_moved_parts_are_no_copies(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(160)]
    texts = []
    for c in range(30):
        own = list(base)
        for at in rng.sample(range(160), c % 4):
            own[at] = f"e{c}x{at}"
        if c % 3 == 1:
            own = own[80:] + own[:80]
        if c % 3 == 2:
            own = own[120:] + own[:120]
        texts.append(" ".join(own))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    parent = list(range(30))
    for _ in texts:
        for a, b in pairs_by_force(texts):
            parent[a] = parent[b] = min(parent[a], parent[b])
    same = {tuple(words(t)): i for i, t in reversed(list(enumerate(texts)))}
    assert got == {i: parent[same[tuple(words(t))]] for i, t in enumerate(texts)}
    assert len(set(got.values())) > 2


def test_recall_of_similar_pairs(spark):
    """Over all documents of the middle table, and two edited copies of some, most of them near the threshold."""
    rng = random.Random(8)
    texts = [r["text"] for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").orderBy("doc_id").collect()]
    for t in [t for t in texts if 60 <= len(words(t)) <= 400][:250]:
        for _ in range(2):
            own = words(t)
            for at in rng.sample(range(len(own)), rng.randint(1, max(1, len(own) // 45))):
                own[at] = f"e{rng.random()}"
            texts.append(" ".join(own))
    of = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    true = pairs_by_force(texts)
    found = sum(of[a] == of[b] for a, b in true)
    print(f"{found} of {len(true)} pairs")
    assert len(true) > 300 and found >= 0.99 * len(true)
    parent = list(range(len(texts)))
    for a, b in true:
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)
    root = lambda i: i if parent[i] == i else root(parent[i])
    copies = {}
    for i, t in enumerate(texts):
        first = root(copies.setdefault(tuple(words(t)), i))
        parent[max(first, root(i))] = min(first, root(i))
    assert of == {i: root(i) for i in range(len(texts))}


# quality classifier: features and score of a row in plain Python

MASK = (1 << 64) - 1


def mix(h):
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & MASK
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & MASK
    return h ^ h >> 33


def span_hash(data):
    pieces = [int.from_bytes(data[i : i + 8], "little") for i in range(0, len(data), 8)] or [0]
    h = mix(pieces[0] ^ len(data) * 0xD1342543DE82EF95 & MASK)
    if len(pieces) > 1:
        h = mix((h + sum(mix(p ^ mix(i * 0x9E3779B97F4A7C15 & MASK)) for i, p in enumerate(pieces) if i)) & MASK)
    return h


def features_of(text, dims):
    mark = lambda b: 33 <= b < 127 and not chr(b).isalnum()
    lower = lambda b: bytes(x + 32 if 65 <= x <= 90 else x for x in b)
    raw = [w.encode() for w in words(text)]
    codes, bodies, marks, shouts = [], [], 0, 0
    for w in raw:
        body, tail = w, b""
        for _ in range(4):
            if len(body) > 1 and mark(body[-1]):
                body, tail = body[:-1], body[-1:] + tail
            if len(body) > 1 and mark(body[0]):
                body = body[1:]
        bodies.append(lower(body))
        codes.append(span_hash(lower(body)))
        codes += [span_hash(lower(body)[:n]) ^ 0x2545F4914F6CDD1D for n in (4, 6) if len(body) > n]
        if tail:
            marks += 1
            codes.append(span_hash(lower(tail)) ^ 0x5851F42D4C957F2D)
        shouts += sum(65 <= b <= 90 for b in w) >= 2
    n = max(1, len(raw))
    grams = [tuple(bodies[i : i + 3]) for i in range(len(raw) - 2)]
    shape = [min(9, 10 * marks // n), min(9, 10 * shouts // n), min(9, 10 * len(set(grams)) // max(1, len(grams))), min(15, int(math.log2(n)))]
    codes += [mix(((x + 1) * 0x9E3779B97F4A7C15 + i) & MASK) for i, x in enumerate(shape)]
    return {c >> 64 - dims for c in codes}


def test_scores_of_the_classifier_in_plain_python(spark):
    rng = np.random.default_rng(3)
    how = quality_classifier.Fit(dims_log2=14)
    model = quality_classifier.Model(rng.normal(size=1 << 14).astype(np.float32), np.array([-0.5, 0.75]))
    rows = [(r["doc_id"], r["text"], "en", "s") for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(80).collect()]
    rows += [(1000 + i, t, "en", "s") for i, (_, t, *_) in enumerate(ODD)] + [(2000, '"Quoted," (words)... LOUD!! a-b --- ...', "en", "s")]
    docs = frame(spark, rows, ["kept", "__id"])
    got = {r["doc_id"]: r for r in docs.select("doc_id", quality_classifier.judge(F.col("text"), docs, model, how).alias("v")).select("doc_id", "v.*").collect()}
    for i, t, *_ in rows:
        score = sum(float(model.weights[f]) for f in features_of(t, 14))
        above = [1 / (1 + math.exp(cut - score)) for cut in (-0.5, 0.75)]
        assert (got[i]["p_grade1"], got[i]["p_grade2"], got[i]["expected_grade"]) == pytest.approx((*above, sum(above)), abs=1e-6)
        assert got[i]["kept"] == (above[1] >= 0.5)


# secret scan: every window's entropy anew


def entropy_spans(text, c, base):
    out = []
    for m in re.finditer(c.candidate, text):
        pieces = [(m.start(1), m[1])]
        if re.search(secret_scan.PLACEHOLDER, m[1]):
            pieces = [(m.start(1) + p.start(), p[0]) for p in re.finditer(secret_scan.BESIDE, m[1]) if len(p[0]) >= c.window]
        for at, found in pieces:
            if re.search(secret_scan.ALLOWED.replace(r"\z", r"\Z"), found) or any(a <= at and at + len(found) <= b for a, b in base):
                continue
            entropy = lambda s: -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())
            high = [i for i in range(len(found) - c.window + 1) if entropy(found[i : i + c.window]) >= c.limit - 1e-9]
            if high:
                out.append((at + high[0], at + high[-1] + c.window, c.kind))
    return out


def test_entropy_spans_by_brute_force(spark):
    rng = random.Random(9)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(100).collect()]
    for n in (19, 20, 21, 23, 24, 40, 90):
        texts += [f"x {some('0123456789abcdef', n)} y {some('0123456789ABCDEF', n)}", f"key={some('abcXYZ0123456789+/', n)}= {some('ab', n)}1", f"sample/{some('abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789', n)}-{some('aab', n)}"]
    texts += ["token=" + some("0123456789abcdefXYZ", 40) + " 日本 " + some("0123456789abcdef", 30), "a" * 30 + "1", "é" + some("abcdefghijklmnop0123456789ABCDEF", 64)]
    got = secret_scan.scan_secrets(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    hits = 0
    for r, t in zip(got, texts, strict=True):
        base = [(m.start(), m.end()) for _, p, g, least in secret_scan.BASE for m in re.finditer(p, t) if len(m[g]) >= least]
        want = sorted(x for c in secret_scan.CLASSES for x in entropy_spans(t, c, base))
        have = sorted((int(a), int(b), kind) for kind, a, b in (s.split(":") for s in r["spans"].split(",") if s) if kind.startswith("entropy"))
        assert have == want, t[:200]
        hits += len(want)
    assert hits > 20
