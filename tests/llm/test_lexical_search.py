"""Ranked search against plain sums."""

import math
import re
from collections import Counter

import duckdb
import pytest
from broadsheet.llm import lexical_search
from broadsheet.llm.lexical_search import Search

from .conftest import ODD, SF, frame

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans(lexical_search.UPPER, lexical_search.LOWER)


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def expected(docs, items, top=20):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, length = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, query in asked.items():
        scores = []
        for i, c, n in counted:
            m = 75 + 25 * n * n_docs // length
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in query.items() if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("how", [Search(), Search(hot=3, slice_rows=20, bucket_rows=50, block_terms=40)])
def test_whole_tables(spark, documents, how):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = expected([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows(lexical_search.lexical_search(documents, items, how)) == sorted(want, key=repr)


def test_sql(spark, documents):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    got = lexical_search.lexical_search(documents, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert rows(got) == sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({lexical_search.oracle()})").fetchall(), key=repr)


def test_odd_rows(spark):
    items = [(1, "One, TWO three wörter"), (1, "w5 w5"), (2, None), (3, ""), (None, "seven x"), (4, "nowhere")]
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, score int")
    got = lexical_search.lexical_search(frame(spark, ODD, ["term", "row", "score", "tf"]), asked)
    assert rows(got) == sorted(expected([(i, t) for i, t, *_ in ODD], items), key=repr)
    assert lexical_search.lexical_search(frame(spark, ODD).limit(0), asked).count() == 0
    assert lexical_search.lexical_search(frame(spark, ODD), asked.limit(0)).count() == 0


def test_an_index_of_all_terms_serves_any_items(spark, documents):
    index = lexical_search.build_index(documents, how=Search(hot=10))
    items = spark.createDataFrame([(1, "the and ending"), (2, "de la que")], "item_id long, text string")
    want = expected([(r.doc_id, r.text) for r in documents.collect()], [(1, "the and ending"), (2, "de la que")])
    assert rows(lexical_search.search(index, lexical_search.item_terms(items))) == sorted(want, key=repr)


def test_ties_go_by_document(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in (5, 3, 9, 3)] + [(7, "other text")], "doc_id long, text string")
    got = rows(lexical_search.lexical_search(docs, spark.createDataFrame([(1, "same")], "item_id long, text string"), Search(top=3)))
    assert [r[2] for r in got] == [3, 3, 5] and len({r[3] for r in got}) == 1
