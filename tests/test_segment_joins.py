"""Candidates of segment joins are chosen by place, not by number."""

from pathlib import Path

import pytest
from broadsheet.operators import spatial
from broadsheet.plans import registry
from pyspark.sql import functions as F

SF = Path("/root/testdata/sf0.001")
registry.load()


def test_following_by_brute_force(spark):
    boxes = [(i % 2, i, float(i * 37 % 1000), float(i * 91 % 1000)) for i in range(1, 120)]
    ends = spark.createDataFrame([(p, i, x + 9, y + 5) for p, i, x, y in boxes], "page long, a long, x double, y double")
    starts = spark.createDataFrame(boxes, "page long, b long, x double, y double")
    got = [tuple(r) for r in spatial.following(ends, starts, 500.0).collect()]
    want = [(p, a, b) for p, a, x, y in boxes for q, b, v, w in boxes if p == q and a != b and ((v - x - 9) ** 2 + (w - y - 5) ** 2) ** 0.5 < 500]
    assert sorted(got) == sorted(want)


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
def test_pairs_far_apart_in_number_get_a_code(spark):
    """Candidates are chosen by place: neighbours may have any numbers."""
    d = str(SF.parent / "sf0.01")
    for name in ("segment_near_join_codes", "segment_join_codes"):
        far = registry.QUERIES[name](spark, d).filter(F.abs(F.col("b") - F.col("a")) > 100)
        assert far.filter("code = 'joined'").count() > 0
