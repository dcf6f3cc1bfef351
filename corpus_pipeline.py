"""Documents to shards: quality, near duplicates, benchmark leaks, mix, shards.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before
it kept. All but the last return the columns of ``documents``, whatever their names.

Null and empty texts are judged by the classifier as texts without features; those that it keeps are
copies of each other, of which one stays. Repeated rows are copies too, so no later
stage meets them. A null doc_id counts as the empty key. Null lang and source are
the value ''. Texts of any length are taken whole. Without labels every document is kept by the first stage;
an empty benchmark removes nothing; empty documents give an empty result.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import decontamination, mixing, near_dedup, quality_classifier, sharding
from broadsheet.llm.cluster import written


def _rows(docs: DataFrame, found: Column, stays: Column) -> DataFrame:
    """The rows whose finding passes. The row is packed, so that none of its columns can clash with the finding."""
    own = docs.columns
    packed = docs.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(own)]).alias("row"), found)
    return packed.filter(stays).select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(own)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier rates good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdict = quality_classifier.judge(F.col("text"), docs, quality_classifier.train(docs, labels))
    return _rows(docs, verdict.alias("found"), F.col("found.kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _rows(docs, decontamination.matches(F.col("text"), benchmark).alias("found"), F.size("found") == 0)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the token budget of the mix takes, each at most once."""
    return mixing.take_mix(docs, replace(mixing.TARGET, max_epochs=1))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document."""
    return sharding.shard_documents(docs, keep=["doc_id", "lang", "source"])


STAGES = [("quality classifier", quality), ("near-dedup", near_duplicates), ("benchmark decontamination", benchmark_leaks), ("mixing", mix), ("sharding", shards)]

#: The classifier and the near-duplicate classes have no SQL form; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
