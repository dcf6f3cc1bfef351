"""The registered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, lexical_search, line_rules, lm_score, mixing, near_dedup, piece_codec, quality_classifier, secret_scan, sharding, substring_dedup, token_alignment, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_rules(_table(spark, sf_dir))


def op2_cleaned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.cleaned_text(_table(spark, sf_dir))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(_table(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_table(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(_table(spark, sf_dir), str(public_tokenizers.path("piece_bpe_32k.model")))


def op10_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir), keep=["doc_id"])


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_codec.encode_digests(_table(spark, sf_dir), str(public_tokenizers.path("piece_bpe_32k.model")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.align(_table(spark, sf_dir), *(str(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(_table(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


_ALL = (op1_ordinal_quality, op2_line_rules, op2_cleaned_text, op3_mix_sources, op4_substring_dedup, op5_near_dedup, op6_decontaminate, op7_secret_scan, op8_lm_score, op9_token_counts, op10_hash_tree, op11_piece_codec, op12_token_alignment, op13_lexical_search)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op2_line_rules": line_rules.oracle(), "op3_mix_sources": mixing.oracle(), "op4_substring_dedup": substring_dedup.oracle(), "op6_decontaminate": decontamination.oracle(), "op10_hash_tree": sharding.oracle(), "op13_lexical_search": lexical_search.oracle()}
