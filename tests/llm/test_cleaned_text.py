"""The texts that the line rules leave."""

from dataclasses import replace

from broadsheet.llm import line_rules
from pyspark.sql import functions as F

from .conftest import ODD, frame
from .test_native import no_python

RULES = replace(line_rules.LineRules(), max_docs=2)


def test_frequent_lines_are_cut_out_in_place(spark):
    own = lambda i: " ".join(f"d{i}n{k}" for k in range(60))
    rows = [(i, f"Head {i}\n\n  Common   LINE\n{own(i)}\ncommon line\n \ntail {i}\n", "en", "a") for i in range(30)]
    rows += [(50, f"common line\n{own(50)}", "en", "b"), (51, "common line", "en", "a"), (52, "common line\ncommon line\n", "en", "a"), (53, None, "en", "a")]
    got = {r["doc_id"]: r for r in line_rules.cleaned_text(frame(spark, rows, ["text2"])).collect()}
    assert len(got) == len(rows)
    for i in range(30):
        assert got[i]["text"] == f"Head {i}\n\n{own(i)}\n \ntail {i}\n" and got[i]["n_removed_words"] == 4 and got[i]["kept"]
    assert got[50]["text"] == rows[30][1] and got[50]["n_removed_words"] == 0
    assert [(got[i]["text"], got[i]["n_removed_words"], got[i]["kept"]) for i in (51, 52, 53)] == [("", 2, False), ("", 4, False), ("", 0, False)]


def test_text_and_verdict_agree(spark, documents):
    for docs in (documents, frame(spark, ODD, ["kept", "n_words", "host", "gone"])):
        df = line_rules.cleaned_text(docs, RULES)
        assert no_python(df)
        counted = df.select("doc_id", "n_removed_words", "kept", F.size(line_rules.words_of(F.col("text"))).cast("long").alias("left"))
        verdict = line_rules.line_rules(docs, RULES).selectExpr("doc_id", "n_removed_words", "kept", "n_words - n_removed_words as left")
        assert sorted(map(tuple, counted.collect()), key=repr) == sorted(map(tuple, verdict.collect()), key=repr)
