"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from presswork.llm import crosstok, decontaminate, htmlwrap, lmscore, mix, neardup, negatives, pieces, quality, shard, suffixes, tokens, warc
from presswork.llm.common import table

SHARD_TREE = shard.HashTree.regular(regions=2, racks=4, shards=5)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlwrap.extract(table(spark, sf_dir, "pages"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.digest(table(spark, sf_dir, "documents"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.digest(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digest(table(spark, sf_dir, "documents"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_rows(table(spark, sf_dir, "documents"), SHARD_TREE)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.digest(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.digest(table(spark, sf_dir, "embeddings"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_near_dedup": op2_near_dedup,
    "op3_mix": op3_mix,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_warc": op5_warc,
    "op6_token_output": op6_token_output,
    "op7_shard": op7_shard,
    "op8_lm_score": op8_lm_score,
    "op9_quality": op9_quality,
    "op10_decontaminate": op10_decontaminate,
    "op11_token_align": op11_token_align,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_pieces": op13_pieces,
}

ORACLES = {
    "op5_warc": warc.DIGEST_SQL,
    "op7_shard": shard.shard_sql(SHARD_TREE),
    "op9_quality": quality.digest_sql(),
    "op10_decontaminate": decontaminate.digest_sql(),
    "op12_hard_negatives": negatives.DIGEST_SQL,
}
