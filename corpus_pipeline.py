"""A corpus pipeline over `documents`: quality classifier, quality rules, SimHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns a DataFrame that is
written and read again as the next one's docs. All but the last return the columns of documents. What a stage does with
nulls, repeated rows, empty tables and further columns is told where its operator is defined; an empty table passes
through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import materialize, table
from gridloom.llm.near import keep_one
from gridloom.llm.outliers import keep_documents
from gridloom.llm.packing import pack_documents
from gridloom.llm.quality import rated_documents, select_documents, train


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model keeps."""
    return select_documents(docs, train(docs, rated_documents(table(spark, sf_dir, "labels"))))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return keep_documents(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: shingles of five words, similarity 0.8 or more."""
    return keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document that is left, with its place in a training sequence."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("best-fit packing", best_fit_packing),
]

#: Training, fingerprints and tokenizing have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
