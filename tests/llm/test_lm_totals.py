"""The language model's totals by context hold every run below the context, kept or not."""

import math
import zlib
from collections import Counter

import pytest
from broadsheet.llm import lm_score

from .conftest import ODD, frame, words
from .test_free import lower, small


def scores(rows, how):
    """Scores where count(context) is the number of all words that follow it."""
    own = [["<s>", *words(lower(t)), None] for _, t, *_ in rows]
    held = [zlib.crc32(str("" if d is None else d).encode()) % how.folds == how.held_fold for d, *_ in rows]
    counts = [Counter(tuple(x[i - n : i + 1]) for x, h in zip(own, held, strict=True) if not h for i in range(max(1, n), len(x))) for n in range(how.order)]
    follow, kept = Counter(), Counter()
    for level in counts[1:]:
        for run, c in level.items():
            follow[run[:-1]] += c
        for run, c in level.items():
            kept[run[:-1]] += (c - how.discount) / follow[run[:-1]] if c >= how.min_count else 0
    total, size = sum(counts[0].values()), len(counts[0])
    out = []
    for x in own:
        full = 0.0
        for i in range(1, len(x)):
            p = (counts[0][(x[i],)] + 1) / (total + size + 1)
            for n in range(1, min(how.order - 1, i) + 1):
                run = tuple(x[i - n : i + 1])
                if not (counts[n - 1][run[:-1]] >= how.min_count if n > 1 else run[0] == "<s>" or counts[0][run[:1]]):
                    break
                c = counts[n][run]
                p = ((c - how.discount) / follow[run[:-1]] if c >= how.min_count else 0) + max(1e-9, 1 - kept[run[:-1]]) * p
            full += math.log10(p)
        out.append((len(x) - 1, full))
    return out


def test_a_run_over_a_pruned_pair_counts_in_its_context(spark):
    train, held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2], next(i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(i, t, "en", "s") for i, t in zip(train, ["a b c"] * 3 + [f"a b d{k}" for k in range(9)], strict=False)] + [(held, "a b c", "en", "s")]
    got = lm_score.score_documents(frame(spark, rows)).filter(f"doc_id = {held}").first()["score"]
    single = lambda c: (c + 1) / (48 + 13 + 1)
    a = 11.25 / 12 + 0.75 / 12 * single(12)
    b = (11.25 / 12 + 0.75 / 12 * (11.25 / 12 + 0.75 / 12 * single(12)))
    c = 2.25 / 12 + 9.75 / 12 * (2.25 / 12 + 9.75 / 12 * single(3))  # 12 words follow 'a b', 3 of them 'c'
    end = 2.25 / 3 + 0.75 / 3 * (2.25 / 3 + 0.75 / 3 * single(12))
    assert got == pytest.approx(sum(map(math.log10, (a, b, c, end))), abs=4 * 0.51 / 4096)


@pytest.mark.parametrize("how", [lm_score.Lm(), lm_score.Lm(order=4, flush=1000, range_tokens=200)])
def test_totals_by_brute_force(spark, documents, how):
    rows = small(documents, 60) + ODD
    got = lm_score.score_documents(frame(spark, rows), how).orderBy("doc_id", "n_tokens", "score").collect()
    want = sorted(((r[0], *s) for r, s in zip(rows, scores(rows, how), strict=True)), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    assert all(g["n_tokens"] == n and abs(g["score"] - s) <= 1e-9 + n * 0.51 / 4096 for g, (_, n, s) in zip(got, want, strict=True))
