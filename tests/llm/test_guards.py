"""Keys that would wrap raise; ties between rows of one document are settled by all columns."""

import pytest
from broadsheet.llm import lm_score, near_dedup

from .conftest import frame


def test_keys_that_would_wrap_raise(spark, documents):
    docs = documents.limit(50)
    with pytest.raises(ValueError, match="key_bits|bits"):
        lm_score.train(docs, lm_score.Lm(key_bits=16))
    assert len(lm_score.train(docs, lm_score.Lm(key_bits=40))) == 3


def test_rows_of_one_document_leave_the_same_one(spark):
    rows = [(1, "one two three four five six", lang, s) for lang in ("en", "de", "fr") for s in ("a", "b")] + [(2, "another text of some more words", "en", "a")]
    seen = {tuple(sorted(map(tuple, near_dedup.keep_one(frame(spark, rows[::step]).repartition(n)).collect()))) for n in (1, 3, 7) for step in (1, -1)}
    assert len(seen) == 1 and len(next(iter(seen))) == 2


def test_texts_are_not_shuffled_by_the_list_of_those_that_stay(spark, tmp_path):
    rows = [(i, f"text {i % 700} of words {i % 700 * 7} that differ {i % 700 * 13} by {i % 700} number", "en", "s") for i in range(1000)]
    frame(spark, rows).repartition(5).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    kept = near_dedup.keep_one(docs)
    assert sorted(tuple(r)[:4] for r in kept.collect()) == [r for r in rows if r[0] < 700]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # the list of those that stay is a bit a row: five files of some 200 rows are five short rows
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        plan = near_dedup.keep_one(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_rows_that_share_a_place_in_their_file_are_told_apart(spark, tmp_path):
    rows = [(i, f"the text {i} and {i * 3} of so {i * 7} many words", "en", "s") for i in range(40)]
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    # each row of the file gives two of different text
    twice = docs.crossJoin(spark.range(2).withColumnRenamed("id", "n")).selectExpr("doc_id * 2 + n as doc_id", "if(n = 0, text, concat('quite another ', doc_id, ' ', doc_id * 11, ' wording ', doc_id * 5)) as text", "lang", "source")
    assert near_dedup.keep_one(twice).count() == 80
    assert near_dedup.keep_one(twice.union(twice)).count() == 80
    assert near_dedup.keep_one(docs.union(docs)).count() == 40
    assert sorted(r.doc_id for r in near_dedup.keep_one(docs.filter("doc_id % 3 = 1")).collect()) == list(range(1, 40, 3))


def test_rows_are_picked_by_a_list_of_bits(spark):
    numbers = [(p << 33) + i for p in (0, 1, 5) for i in (0, 1, 7, 8, 32767, 32768, 40000)]
    for listed in (numbers[::2], numbers[1::3], numbers, []):
        table = spark.createDataFrame([(n, str(n)) for n in numbers], "row long, tokens string")
        got = near_dedup._among(table, spark.createDataFrame([(n,) for n in listed], "row long"))
        assert got.columns == table.columns and sorted(map(tuple, got.collect())) == [(n, str(n)) for n in sorted(listed)]
