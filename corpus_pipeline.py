"""From raw documents to an ordered training mix, in stages that each read the last one's table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.llm import curriculum, decontamination, jaccard, language, line_dedup
from chronolode.llm.common import stored, table
from chronolode.llm.queries import prepare


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    prepare(spark)
    return language.accepted(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line matches."""
    prepare(spark)
    return line_dedup.deduplicated(docs).withColumn(
        "n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    prepare(spark)
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    prepare(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every time a document is taken, with its position in training, in order."""
    prepare(spark)
    return curriculum.training_order(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("curriculum_mix", mixing),
]

# Language identification and alignment scores have no SQL; the tests compare each stage
# with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
