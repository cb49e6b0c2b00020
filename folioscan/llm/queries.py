"""The queries of the training-data operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bagminhash, chunks, decontaminate, mixing, oracles, preference, quality, sharding, suffixes, topk, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op1_norm_sorted_topk(table(spark, sf_dir, "embeddings"))


def op2_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op2_noisy_channel(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op3_pu_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.op4_suffix_merge(table(spark, sf_dir, "documents"))


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.op5_bagminhash(table(spark, sf_dir, "documents"))


def op6_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.op6_preference_pairs(table(spark, sf_dir, "conversations"))


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op7_minimax_shards(table(spark, sf_dir, "documents"))


def op8_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.op8_gear_chunks(table(spark, sf_dir, "documents"))


def op9_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op9_sainte_lague(table(spark, sf_dir, "documents"))


def op10_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op10_wu_manber(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_norm_sorted_topk, op2_noisy_channel, op3_pu_quality, op4_suffix_merge, op5_bagminhash, op6_preference_pairs, op7_minimax_shards, op8_gear_chunks, op9_sainte_lague, op10_wu_manber)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_norm_sorted_topk": topk.ORACLE,
        "op4_suffix_merge": oracles.SUFFIXES,
        "op5_bagminhash": oracles.NEAR_DUPLICATES,
        "op6_preference_pairs": preference.ORACLE,
        "op10_wu_manber": oracles.DECONTAMINATION,
    }
