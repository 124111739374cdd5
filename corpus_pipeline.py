"""A training corpus from raw documents: each stage applies one operator to all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from courtside.llm import decontamination, jaccard, language_id, packing, pii
from courtside.llm.common import shared_folder, staged, table
from courtside.llm.queries import KEY, WORD_VOCABULARY
from courtside.session import tune


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; fitted on the labelled rows among them."""
    tune(spark)
    return language_id.accepted(docs, language_id.fit(language_id.training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word n-grams at 0.8."""
    tune(spark)
    return jaccard.keep_first(docs).select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a test item."""
    tune(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates."""
    tune(spark)
    return pii.pseudonymised(docs, KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids."""
    tune(spark)
    return packing.pack(docs, WORD_VOCABULARY)


STAGES = [("language ID", languages), ("near duplicates", near_duplicates), ("decontamination", benchmark_free),
          ("personal data", without_personal_data), ("packing", packed)]
ORACLE_SQL = None  # fitted models and tokenizers; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; each result is written and read again before the next."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage_{number}", folder)
    return docs
