"""The operators bound to the given tables, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from courtside.llm import (chosen_path, collocations, decontamination, jaccard, language_id, licenses, packing, pii, secrets, sharding, token_files,
                           topk, whitening)
from courtside.llm.common import shared_folder, table

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
KEY = b"courtside"  # of the surrogates; a real run brings its own

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.query(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.query(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(table(spark, sf_dir, "documents"), KEY)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.query(table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.query(table(spark, sf_dir, "embeddings"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token_files"
    return token_files.query(spark, table(spark, sf_dir, "documents"), path, BYTE_VOCABULARY)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.query(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.query(table(spark, sf_dir, "embeddings"))


def op12_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.query(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_decontamination, op2_licenses, op3_jaccard_join, op4_pii, op5_sharding, op6_language_id, op7_top_k,
    op8_token_files, op9_secrets, op10_packing, op11_whitening, op12_near_duplicates, op13_collocations)}
ORACLES: dict[str, str] = {"op3_jaccard_join": jaccard.SQL, "op7_top_k": topk.SQL, "op9_secrets": secrets.sql(),
                           "op12_near_duplicates": chosen_path.SQL, "op13_collocations": collocations.SQL}
