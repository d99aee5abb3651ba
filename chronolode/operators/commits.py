"""Commit selection and work planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import short_hash
from .membership import not_in, with_hash
from .ordering import with_row_index

CHUNK_SIZE = 100


def first_parent(parents: Column) -> Column:
    """First parent hash; NULL for a root commit."""
    return F.get(parents, F.lit(0))


def with_parent(commits: DataFrame) -> DataFrame:
    """Commits that have a parent, with the first one as ``previous_hash``."""
    return commits.where(F.size("parents") > 0).withColumn(
        "previous_hash", first_parent(F.col("parents"))
    )


def oldest_first(commits: DataFrame) -> DataFrame:
    return commits.orderBy("project", "pos", "sha")


def newest_first(commits: DataFrame) -> DataFrame:
    return commits.orderBy("project", F.col("pos").desc(), "sha")


def analysed_commits(listed: DataFrame) -> DataFrame:
    """Set of hashes that some valid chunk already lists."""
    return with_hash(listed).select("project", "sha").distinct()


def pending_commits(commits: DataFrame, analysed: DataFrame) -> DataFrame:
    """Commits reachable from the head that no chunk lists yet."""
    return not_in(with_hash(commits.where("on_head")), analysed, ("project", "sha"))


def commit_chunks(pending: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Number the pending commits of each project oldest first and cut them into chunks."""
    numbered = with_row_index(
        pending.select("project", "sha", "pos"), ["project"], "pos", "idx", ties=["sha"]
    )
    return numbered.select(
        "project", "sha", "pos", F.expr(f"idx div {int(size)}").alias("chunk")
    )


def chunk_bounds(chunks: DataFrame) -> DataFrame:
    """First and last hash of each chunk, its file name and its members in order."""
    return (
        chunks.groupBy("project", "chunk")
        .agg(
            F.count(F.lit(1)).alias("n_commits"),
            # A chunk never holds more than its size, so the list is bounded.
            F.array_sort(F.collect_list(F.struct("pos", "sha"))).alias("_in_order"),
        )
        .select(
            "project",
            "chunk",
            "n_commits",
            F.get("_in_order.sha", F.lit(0)).alias("start_commit"),
            F.element_at("_in_order.sha", -1).alias("end_commit"),
            F.col("_in_order.sha").alias("members"),
        )
        .withColumn(
            "chunk_file",
            F.concat(
                F.lit("chunk_"),
                short_hash(F.col("start_commit")),
                F.lit("_"),
                short_hash(F.col("end_commit")),
                F.lit(".json"),
            ),
        )
    )
