"""Membership joins.

No side carries a broadcast hint: the key tables may grow with the data. The
adaptive planner broadcasts them when their measured size allows, and otherwise
splits skewed partitions of the left side, which semi, anti and left joins permit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forget_partitioning(df: DataFrame, *keys: str) -> DataFrame:
    """Have ``df``, partitioned by text ``keys`` already, shuffled for its next use.

    Adaptive execution splits a skewed join partition only where both sides come
    straight out of a shuffle and the result need not stay partitioned. An aggregate
    on the join keys would be joined in its own stage, and a grouping on the join keys
    would run in the join's stage. Rewriting the keys by an expression hides their
    partitioning: some narrow rows are shuffled once more, and a key that holds a third
    of the other side no longer ends in one task.
    """
    hidden = {k: F.concat(F.col(k), F.lit("")) for k in keys if dict(df.dtypes)[k] == "string"}
    return df.withColumns(hidden)


def with_hash(df: DataFrame, sha: str = "sha") -> DataFrame:
    """Drop records without a commit hash."""
    return df.where(F.col(sha).isNotNull() & (F.col(sha) != ""))


def only_in(df: DataFrame, members: DataFrame, on: Sequence[str] = ("project",)) -> DataFrame:
    """Rows whose key is in ``members``; duplicates of ``df`` stay."""
    return df.join(forget_partitioning(members.select(*on).distinct(), *on), list(on), "left_semi")


def not_in(df: DataFrame, members: DataFrame, on: Sequence[str] = ("project",)) -> DataFrame:
    """Rows whose key is not in ``members``; duplicates of ``df`` stay."""
    return df.join(forget_partitioning(members.select(*on).distinct(), *on), list(on), "left_anti")


def listed_projects(df: DataFrame, projects: DataFrame) -> DataFrame:
    """Only projects of the project list."""
    return only_in(df, projects)


def unprocessed_projects(df: DataFrame, results: DataFrame) -> DataFrame:
    """Skip projects that already have a result."""
    return not_in(df, results)


def projects_with_results(df: DataFrame, results: DataFrame) -> DataFrame:
    """Only projects that have refactoring results."""
    return only_in(df, results)
