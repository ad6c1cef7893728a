"""Registered queries of the numbered operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larder.llm import (bpe, crf, decontaminate, langid, licenses, mixing, nbsvm, repetition, secrets, sharding,
                        simhash, trie, whitening)

VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(_table(spark, sf_dir, "documents"), bpe.load(public_tokenizers.path(VOCABULARY)))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(_table(spark, sf_dir, "documents"))


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.report(_table(spark, sf_dir, "documents")).drop("longest_repeat")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.report(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_decontamination, op3_simhash, op4_quality, op5_context_mixing,
                                    op6_language, op7_sharding, op8_repetition, op9_secrets, op10_toxicity,
                                    op11_licenses, op12_whitening, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": decontaminate.sql(), "op8_repetition": repetition.sql(),
            "op11_licenses": licenses.sql(), "op13_prefix_trie": trie.sql()}
