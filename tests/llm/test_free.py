"""Operators with Python on the executors, against brute force, libraries and held-out labels."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from broadsheet.llm import decontamination, lm_score, near_dedup, quality_classifier, substring_dedup, token_counts
from broadsheet.llm import words as words_of
from pyspark.sql import functions as F

from .conftest import ODD, SF, frame, words

duckdb = pytest.importorskip("duckdb")


def small(documents, n=120):
    return [(r[0] + 100_000, *tuple(r)[1:4]) for r in documents.select("doc_id", "text", "lang", "source").orderBy("doc_id").limit(n).collect()]


# quality classifier


def test_classifier_on_labels_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.filter("doc_id % 3 != 0")
    how = quality_classifier.Fit()
    judged = docs.select("doc_id", quality_classifier.judge(F.col("text"), docs, quality_classifier.train(docs, seen, how), how).alias("v")).select("doc_id", "v.*")
    held = labels.filter("doc_id % 3 = 0").join(judged, "doc_id").collect()
    good = [r["kept"] for r in held if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["kept"] for r in held if r["quality"] == 0 or r["toxic"] == 1]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15
    assert all(1 >= r["p_grade1"] >= r["p_grade2"] >= 0 and abs(r["expected_grade"] - r["p_grade1"] - r["p_grade2"]) < 1e-9 for r in held)


def test_thresholds_are_ordered_and_the_fit_finds_the_signal():
    rng = np.random.default_rng(0)
    rows = [[g] * 1 + list(rng.integers(10, 200, 5)) for g in rng.integers(0, 3, 400)]
    index, ptr = np.concatenate(rows), np.arange(401) * 6
    grade = np.array([r[0] for r in rows])
    m = quality_classifier.fit(index, ptr, grade, 3, quality_classifier.Fit(dims_log2=8, min_docs=1))
    assert m.thresholds[0] < m.thresholds[1] and m.weights[0] < m.weights[1] < m.weights[2]
    score = quality_classifier._sums(m.weights, index, ptr)
    assert (np.searchsorted(m.thresholds, score) == grade).mean() > 0.95


def test_classifier_edges(spark):
    docs = frame(spark, ODD, ["kept", "v"])
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert [r["kept"] for r in quality_classifier.classify(docs, none).collect()] == [True] * len(ODD)
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (8, 1, 1), (99, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(docs, labels).count() == len(ODD)
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0


# substring deduplication


def repeats(rows, k):
    w = [words(t) for _, t, *_ in rows]
    seen = Counter(tuple(x[i : i + k]) for x in w for i in range(len(x) - k + 1))
    out = []
    for (doc, *_), x in zip(rows, w, strict=True):
        gone = {i + j for i in range(len(x) - k + 1) if seen[tuple(x[i : i + k])] > 1 for j in range(k)}
        kept = " ".join(v for i, v in enumerate(x) if i not in gone)
        out.append((doc, len(x), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [substring_dedup.Repeats(), substring_dedup.Repeats(window=9, period=7, cover=(0, 1, 3), flush=50), substring_dedup.Repeats(window=7, period=7, cover=(0, 1, 3))])
def test_repeats_by_brute_force(spark, documents, how):
    rng = np.random.default_rng(how.window)
    rows = small(documents, 60) + ODD
    rows += [(1000 + i, " ".join(rng.choice(list("abc"), rng.integers(0, 60))), "en", "s") for i in range(40)]
    rows += [(2000, " ".join(["loop"] * 200), "en", "s")]
    got = substring_dedup.remove_repeats(frame(spark, rows, ["row", "places"]), how, texts=True)
    assert sorted([tuple(r)[:4] for r in got.collect()], key=repr) == repeats(rows, how.window)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got.collect())


def test_cover_is_checked():
    with pytest.raises(ValueError):
        substring_dedup.Repeats(cover=(0, 1, 2))


def test_no_rows_to_deduplicate(spark):
    assert substring_dedup.remove_repeats(frame(spark, ODD).limit(0)).count() == 0


# near duplicates


def classes_by_force(rows, k=5, threshold=0.8):
    sets = []
    for _, t, *_ in rows:
        w, seen = words(t), Counter()
        grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []
        own = set()
        for g in grams:
            own.add((g, seen[g]))
            seen[g] += 1
        sets.append(own)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if words(rows[a][1]) == words(rows[b][1]) or (x and y and len(x & y) >= threshold * len(x | y)):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    key = lambda d: (d is not None, d or 0)
    return Counter((rows[i][0], min((rows[j][0] for j in g), key=key), len(g)) for g in groups.values() for i in g)


def test_near_duplicates_by_brute_force(spark, documents):
    rng = np.random.default_rng(5)
    rows = small(documents, 80) + ODD
    base = [f"b{i}" for i in range(120)]
    for c in range(40):  # a large group of near copies, each with its own edits, and a chain
        own = list(base)
        for at in rng.integers(0, 120, 1 + c % 2):
            own[at] = f"e{c}"
        rows.append((5000 + c, " ".join(own), "en", "s"))
    for c in range(12):
        rows.append((6000 + c, " ".join(f"c{i}" for i in range(c * 9, c * 9 + 200)), "en", "s"))
    got = near_dedup.near_dedup(frame(spark, rows, ["class_id", "tid"]))
    found = got.collect()
    assert Counter(tuple(r)[:3] for r in found) == classes_by_force(rows)
    assert sum(r["kept"] for r in found) == len({(r["class_id"], r["class_size"]) for r in found})


def test_every_pair_of_a_mixed_bucket_is_compared(spark):
    # one shared half puts all texts into common buckets; only some pairs are similar enough
    shared = [f"s{i}" for i in range(100)]
    rows = []
    for g in range(12):
        tail = [f"g{g}x{i}" for i in range(60)]
        rows += [(g * 10 + m, " ".join(shared + tail + [f"m{m}"]), "en", "s") for m in range(3)]
    how = near_dedup.Dedup(sample=1, sketches=6, widen=2)
    got = Counter(tuple(r)[:3] for r in near_dedup.near_dedup(frame(spark, rows), how).collect())
    assert got == classes_by_force(rows)


def test_one_of_each_class_stays(spark):
    docs = frame(spark, ODD, ["row", "__hash"])
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(Counter(r["text"] and " ".join(words(r["text"])) or None for r in kept.collect()).values()) == [1] * kept.count()
    assert near_dedup.keep_one(docs.limit(0)).count() == 0


# decontamination


def test_contained_items_equal_sql(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = small(documents, 100)
    item = bench.orderBy("item_id").first()["text"]
    rows += [(9001, " ".join(f"w{i}" for i in range(20_000)) + " " + item, "en", "s"), (9002, item.rsplit(" ", 3)[0], "en", "s"), (9003, " ".join(item.split(" ")[::2]), "en", "s"), (9004, None, "en", "s")]
    items = [tuple(r) for r in bench.collect()] + [(-5, "a b c d e f"), (-6, "w17 w18 w19"), (-9, "w5"), (-10, " "), (-7, None), (None, item), (-8, item)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows, ["items", "m"])
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    con.register("benchmark", bench.toArrow())
    for how in (decontamination.Containment(), decontamination.Containment(block_items=7)):
        got = decontamination.decontaminate(docs, bench, how)
        cursor = con.execute(decontamination.oracle(how))
        names = [d[0] for d in cursor.description]
        assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, cursor.fetchall()))
    assert {r["doc_id"] for r in got.collect() if r["contaminated"]} >= {9001, 9002}
    assert {"-6", "-9"} <= set(next(r["items"] for r in got.collect() if r["doc_id"] == 9001).split(","))


def test_scattered_shingles_add_up_and_ids_may_be_text(spark):
    item = [f"i{n}" for n in range(60)]
    filler = [f"f{n}" for n in range(3000)]
    rows = [(1, " ".join(item[:32] + filler + item[28:]), "en", "s"), (2, " ".join(filler + item + filler), "en", "s"), (3, " ".join(filler[:5] + ["x", "y", "z"] + filler), "en", "s"), (4, " ".join(item[:30] + filler + item[40:]), "en", "s")]
    bench = spark.createDataFrame([("long", " ".join(item)), ("three", "x y z"), ("both", "x  y\tz")], "item_id string, text string")
    got = {r["doc_id"]: (r["items"], r["best_share"]) for r in decontamination.decontaminate(frame(spark, rows), bench).collect()}
    assert got == {1: ("long", 1.0), 2: ("long", 1.0), 3: ("both,three", 1.0), 4: ("", 0.0)}


def test_containment_does_not_depend_on_the_place():
    """Pieces at every offset, any filler between them, items of 12 to 70 words, whole or with words changed: as plain sets say."""
    how = decontamination.Containment()
    rng = np.random.default_rng(8)
    sizes = [12, 35, 36, 70]
    items = [[f"i{k}w{n}" for n in range(m)] for k, m in enumerate(sizes)]
    index = decontamination.index_items(pa.array(range(len(items))), pa.array([" ".join(i) for i in items]), how)
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    sets = [grams(i) for i in items]
    texts, want = [], []
    for offset in range(0, 65, 4):
        for filler in (10, 30, 60, 120, 200):
            for k, item in enumerate(items):
                cut = len(item) // 2
                first, second = item[: cut + 2], item[cut - 2 :]
                if (offset + filler) % 3 == 0:
                    second[len(second) // 2] = "changed"
                w = [f"p{n}" for n in range(offset)] + first + [f"f{n}" for n in range(filler)] + second + [f"t{n}" for n in range(int(rng.integers(300)))]
                own = grams(w)
                texts.append(" ".join(w))
                want.append({j: len(own & s) / len(s) for j, s in enumerate(sets) if len(own & s) >= 0.8 * len(s) - 1e-9})
    got = [x for block in words_of.blocks(pa.array(texts)) for x in decontamination.contained(block, index, how)]
    assert got == want and sum(map(len, want)) > len(want) / 2


def test_decontamination_edges(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["contaminated"] for r in decontamination.decontaminate(docs, none).collect()} == {False}
    some = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert Counter(r["doc_id"] for r in decontamination.decontaminate(docs, some).collect() if r["contaminated"]) == Counter({4: 2, 5: 1})
    assert decontamination.decontaminate(docs.limit(0), some).count() == 0


# language model


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def scores_by_force(rows, how):
    own = [words(lower(t)) + [None] for _, t, *_ in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, *_ in rows]
    counts = [Counter() for _ in range(how.order)]
    for n in range(how.order):
        for w, h in zip(own, held, strict=True):
            x = ["<s>", *w]
            for i in range(1, len(x)):
                if h or i - n < 0:
                    continue
                run = tuple(x[i - n : i + 1])
                if n < 2 or counts[n - 1][run[:-1]] >= how.min_count:
                    counts[n][run] += 1
    total, size = sum(counts[0].values()), len(counts[0])
    sums = [Counter() for _ in range(how.order)]
    kept = [Counter() for _ in range(how.order)]
    for n in range(1, how.order):
        for run, c in counts[n].items():
            sums[n][run[:-1]] += c
        for run, c in counts[n].items():
            if c >= how.min_count:
                kept[n][run[:-1]] += (c - how.discount) / sums[n][run[:-1]]
    out = []
    for (d, *_), w, h in zip(rows, own, held, strict=True):
        x, base, full = ["<s>", *w], 0.0, 0.0
        for i in range(1, len(x)):
            p = (counts[0][(x[i],)] + 1) / (total + size + 1)
            base += math.log10(p)
            for n in range(1, how.order):
                if i - n < 0:
                    break
                run = tuple(x[i - n : i + 1])
                known = (run[0] == "<s>" or counts[0][run[:1]] > 0) if n == 1 else counts[n - 1][run[:-1]] >= how.min_count
                if not known:
                    break
                c = counts[n][run]
                p = ((c - how.discount) / sums[n][run[:-1]] if c >= how.min_count else 0) + max(1e-9, 1 - kept[n][run[:-1]]) * p
            full += math.log10(p)
        out.append((d, h, len(w), sum(counts[0][(v,)] > 0 for v in w), total, base, full))
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [lm_score.Lm(), lm_score.Lm(order=2, flush=500, range_tokens=200), lm_score.Lm(order=4, flush=1000)])
def test_scores_by_brute_force(spark, documents, how):
    rows = small(documents, 60) + ODD
    got = sorted([tuple(r) for r in lm_score.score_documents(frame(spark, rows, ["score", "s"]), how).collect()], key=repr)
    want = scores_by_force(rows, how)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    # a code is off by at most half a step of log10, for each token
    assert all(abs(g[6] - w[6]) <= 1e-9 + w[2] * 0.51 / 4096 for g, w in zip(got, want, strict=True))


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm_score.score_documents(frame(spark, [(held, "a b", "en", "s")])).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0.0, 0.0)
    assert lm_score.score_documents(frame(spark, ODD).limit(0)).count() == 0


# token counts


def test_tokens_equal_the_library(spark, documents):
    sentencepiece = pytest.importorskip("sentencepiece")
    vocabularies = pytest.importorskip("public_tokenizers")
    path = str(vocabularies.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(0)
    alphabet = list("aeiou thensr.,\n\t  ▁é日😀-=_#/\\0123(){}[]ABCthe\x00\x1c　ﬁ")
    odd = ["a  b", " x ", "<s>hi</s><0x41>", "aaaaaaaaaaaaaaaa" * 50, "ab" * 3000, " " * 4000, "-" * 3000 + "=" * 999, "▁▁a▁b", "\n\n\n"]
    odd += ["".join(rng.choice(alphabet, rng.integers(1, 300))) for _ in range(800)]
    rows = small(documents, 100) + ODD + [(10_000 + i, t, "en", "s") for i, t in enumerate(odd)]
    got = token_counts.count_tokens(frame(spark, rows, ["n_tokens"]), path)
    want = sorted([(d, len((t or "").encode()), n, n > 4096) for (d, t, *_), n in zip(rows, [len(model.encode(t or "")) for _, t, *_ in rows], strict=True)], key=repr)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == want
    assert token_counts.count_tokens(frame(spark, ODD).limit(0), path).count() == 0


def test_the_unit_table_may_be_small():
    vocabularies = pytest.importorskip("public_tokenizers")
    v = token_counts.load_vocabulary(str(vocabularies.path("piece_bpe_32k.model")))
    texts = pa.array([" ".join(f"word{i * 7 % 53}" for i in range(500)), "", "word1"])
    assert token_counts.UnitCounter(v, 3).rows(texts).tolist() == token_counts.UnitCounter(v).rows(texts).tolist()
