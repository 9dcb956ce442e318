"""The opN_ queries: each applies one operator, with production parameters, to its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from broadloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

LLM_QUERIES: dict[str, Query] = {}
LLM_ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    LLM_QUERIES[f.__name__] = f
    return f


@query
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from broadloom.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


@query
def op8_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    from broadloom.llm.quality_net import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from broadloom.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from broadloom.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from broadloom.llm.substrings import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept_text")


@query
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from broadloom.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


@query
def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from broadloom.llm.fuzzy_lines import line_report

    return line_report(table(spark, sf_dir, "documents"))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from broadloom.llm.quality_rules import quality_verdicts

    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from broadloom.llm.pii import personal_spans

    return personal_spans(table(spark, sf_dir, "documents"))


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from broadloom.llm.secrets import secret_spans

    return secret_spans(table(spark, sf_dir, "documents"))


@query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from broadloom.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op12_repair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from broadloom.llm.conversations import damaged, repair_report

    return repair_report(damaged(table(spark, sf_dir, "conversations")))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from broadloom.llm.runs import periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents"), damage=True)
