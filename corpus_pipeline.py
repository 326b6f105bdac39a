"""From raw documents to packed training sequences: five stages, each written and read again.

1. quality rules: documents that a rule rejects go
2. quality classifier: documents that score below the threshold go
3. n-gram Jaccard join: of each group of near duplicates the document with the smallest id stays
4. PII: personal data in the texts gives way to its kind
5. packing: token ids of all that is left, in windows of 2048; one row per piece, with its ids and place

The first four return the columns of ``documents``; a column or row that a stage doesn't decide on passes
unchanged, null or not. An empty table passes every stage as an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barspan.llm import classifier, jaccard, packing, pii, rules
from barspan.llm.queries import WORD_MODEL, documents, vocabulary
from barspan.plans.tables import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Bytes of a batch on its way to a Python worker: executor and worker each hold one whole, the operators slices of 1 MB of it.
BATCH_BYTES = 4_000_000


def in_small_batches(stage: Stage) -> Stage:
    """The stage, in a session that sends BATCH_BYTES at a time; rows are computed when they are read, so the setting stays."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.passed(docs)


@in_small_batches
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from the labelled documents that are left."""
    weights = classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.kept_rows(docs, weights)


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


@in_small_batches
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


@in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary(WORD_MODEL).decode())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: A trained classifier decides in stage 2; tests compare the stages with plain versions instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
