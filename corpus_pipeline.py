"""A training corpus from ``documents``: quality, line dedup, near-duplicate documents,
benchmark leaks, mixing. Each stage works on what the one before it kept.

A part of the training-data operators (broadloom/llm); the rest of the repository works
without this file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from broadloom.llm.decontaminate import without_leaks
from broadloom.llm.fuzzy_lines import without_line_copies
from broadloom.llm.jaccard_join import one_of_each
from broadloom.llm.mixing import mixed_documents
from broadloom.llm.quality_net import good_documents
from broadloom.llm.shared import materialize
from broadloom.sources.tables import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, or nearly so, go; documents stay."""
    return without_line_copies(docs).select(docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the number of words that it reads from each."""
    return mixed_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixing),
]

#: A trained network and drawn mixes are beyond SQL. tests/llm checks that the stages run and
#: keep the columns, and holds brute-force versions of single operators, none of the pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
