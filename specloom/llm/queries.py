"""The registered queries of the training-data operators: each runs one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from specloom.llm import oracles
from specloom.llm.chat import REPLY, events_of, link_tool_calls
from specloom.llm.common import table
from specloom.llm.html import page_texts
from specloom.llm.leaks import benchmark_leaks
from specloom.llm.licences import licence_scan
from specloom.llm.near import jaccard_join
from specloom.llm.packing import harmonic_pack
from specloom.llm.quality import importance_resampling
from specloom.llm.rules import divergence_rules
from specloom.llm.token_counts import token_counts
from specloom.llm.toxicity import toxicity_scores, train


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, train(docs, table(spark, sf_dir, "labels")))


def op6_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(events_of(table(spark, sf_dir, "conversations")), REPLY)


def op7_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_rules(table(spark, sf_dir, "documents"))


def op8_simhash_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_importance_resampling,
        op2_harmonic_packing,
        op3_site_style_tree,
        op4_licence_scan,
        op5_toxicity,
        op6_tool_call_linking,
        op7_divergence_rules,
        op8_simhash_benchmark_leaks,
        op9_transducer_token_counts,
        op10_parity_sketch_join,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op6_tool_call_linking": oracles.TOOL_CALLS_SQL,
    "op7_divergence_rules": oracles.divergence_rules_sql(),
    "op10_parity_sketch_join": oracles.JACCARD_JOIN_SQL,
}
