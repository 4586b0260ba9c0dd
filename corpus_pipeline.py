"""A corpus pipeline: quality, toxicity, near duplicates, benchmark leaks, packing. Each stage works on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import cut, table
from specloom.llm.leaks import benchmark_leaks
from specloom.llm.near import jaccard_join
from specloom.llm.packing import harmonic_pack
from specloom.llm.quality import importance_resampling
from specloom.llm.toxicity import toxicity_scores, train

#: SQL has no n-gram models, classifier or tokenizer; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None

#: Ids up to which those that go are broadcast, about 30 MB; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id isn't in `out`. The texts aren't shuffled for few ids."""
    out = cut(out.select(F.col("doc_id").alias("out_id")).distinct(), "out")
    out = F.broadcast(out) if out.count() <= BROADCAST_IDS else out
    return docs.join(out, F.col("doc_id") == F.col("out_id"), "left_anti")


def _judged(docs: DataFrame, labels: DataFrame | None, gone: Callable[[DataFrame, DataFrame | None], DataFrame]) -> DataFrame:
    """The rows of `docs` that stay: those whose doc_id isn't in `gone`(docs, labels).

    Decisions are a row's own. Where ids are null or repeat, rows are told apart by numbers that are written with them, and
    labels go by these.
    """
    if docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        return _without(docs, gone(docs, labels))
    number, named = "row_number_of_stage", "doc_id_of_stage"
    rows = cut(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumnRenamed("doc_id", named).withColumnRenamed(number, "doc_id")
    if labels is not None:
        own = rows.select(F.col("doc_id").alias(number), F.col(named).alias("doc_id"))
        labels = labels.join(own, "doc_id").drop("doc_id").withColumnRenamed(number, "doc_id")
    left = _without(rows, gone(rows, labels))
    return left.drop("doc_id").withColumnRenamed(named, "doc_id").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that importance resampling keeps."""
    return _judged(docs, table(spark, sf_dir, "labels"), lambda d, labels: importance_resampling(d, labels).filter("NOT kept"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't told to be toxic; the classifier learns from the labelled rows among `docs`."""
    return _judged(docs, table(spark, sf_dir, "labels"), lambda d, labels: toxicity_scores(d, train(d, labels)).filter("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the least doc_id, and all that are no copies."""
    return _judged(docs, None, lambda d, _: jaccard_join(d).filter("doc_id <> component_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item."""
    return _judged(docs, None, lambda d, _: benchmark_leaks(d, table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences."""
    return harmonic_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
