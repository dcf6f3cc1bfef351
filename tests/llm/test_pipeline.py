"""The pipeline's stages, each against a plain account of its own input."""

import corpus_pipeline
from broadsheet.llm import decontamination, mixing, near_dedup, quality_classifier
from broadsheet.llm.cluster import written

from .conftest import ODD, SF, frame, words


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, SF), name.replace(" ", "-"))
        kept[name] = before, docs
        if name != "sharding":
            assert docs.columns == columns
            assert docs.exceptAll(before).isEmpty()
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())

    before, after = kept["quality classifier"]
    verdict = quality_classifier.classify(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == ids(verdict.filter("kept"))

    before, after = kept["near-dedup"]
    assert ids(after) == ids(near_dedup.near_dedup(before).filter("kept"))
    texts = [tuple(words(r["text"])) for r in after.collect()]
    assert len(set(texts)) == len(texts)

    before, after = kept["benchmark decontamination"]
    bench = [r["text"].split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = [{tuple(b[i : i + 5]) for i in range(len(b) - 4)} for b in bench]

    def clean(text):
        w = words(text)
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        return all(len(own & g) < decontamination.Containment().threshold * len(g) for g in grams)

    assert ids(after) == sorted(r["doc_id"] for r in before.collect() if clean(r["text"]))

    before, after = kept["mixing"]
    total = lambda df: sum(len(words(r["text"])) for r in df.collect())
    assert total(after) <= mixing.TARGET.fraction * total(before)
    assert total(after) >= 0.5 * mixing.TARGET.fraction * total(before)

    before, after = kept["sharding"]
    assert ids(after) == ids(before)
    rows = after.collect()
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))

    assert sorted(map(repr, corpus_pipeline.run(spark, SF).collect())) == sorted(map(repr, rows))


def test_edges(spark, tmp_path):
    own = ["found", "row", "__v", "__m", "__row", "__key", "c0"]
    labels = spark.createDataFrame([(4, 1, 0), (7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, "x")], "item_id long, text string")
    for name, rows in (("odd", ODD), ("none", [])):
        at = str(tmp_path / name)
        docs = frame(spark, rows, own)
        for table, df in (("documents", docs), ("labels", labels.limit(len(rows))), ("benchmark", bench.limit(len(rows)))):
            df.write.parquet(f"{at}/{table}.parquet")
        docs = spark.read.schema(docs.schema).parquet(f"{at}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            after = written(f(spark, docs, at), stage.replace(" ", "-"))
            assert after.columns == docs.columns
            assert after.exceptAll(docs).isEmpty()
            if stage == "near-dedup" and rows:
                assert len({tuple(words(r["text"])) for r in docs.collect()}) == after.count()
            if stage == "benchmark decontamination":
                assert not {"one two three four five six seven", "x"} & {r["text"] for r in after.collect()}
            docs = after
        out = corpus_pipeline.STAGES[-1][1](spark, docs, at)
        assert out.count() == docs.count() == corpus_pipeline.run(spark, at).count()


def test_sql_is_left_out():
    assert corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-dedup", "benchmark decontamination", "mixing", "sharding"]
