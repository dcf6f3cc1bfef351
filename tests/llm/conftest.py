import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
#: Documents that every operator has to take: nulls, empty, blank, ties, repeated rows, clashing columns, a long text.
ODD = [
    (1, None, "en", "src1"),
    (2, "", "en", "src1"),
    (3, " \n\t \n", None, None),
    (4, "one two three four five six seven", "en", "src1"),
    (4, "one two three four five six seven", "en", "src1"),
    (5, "one two three four five six seven", "de", "src2"),
    (None, "a null id", "fr", None),
    (6, "x", "en", "other"),
    (7, "wörter über straße 日本 😀   \x1c ende", "de", "src2"),
    (8, " ".join(f"w{i % 977}" for i in range(30_000)), "en", "src1"),
]


def words(text):
    return WORD.findall(text or "")


def frame(spark, rows, clash=()):
    """Documents with columns that bear names of results."""
    df = spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *[f"'mine' as {c}" for c in clash])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
