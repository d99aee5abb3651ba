"""Lines of code per snapshot and their change against the first parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_programming_language, or_default
from ..functions.authors import NO_HASH, UNKNOWN
from .commits import first_parent
from .membership import forget_partitioning, with_hash

OK = "ok"
TOOL_FAILED = "tool_failed"
CHECKOUT_FAILED = "checkout_failed"


def programming_rows(loc_reports: DataFrame) -> DataFrame:
    """Report rows of the counted languages; the filter reaches the scan."""
    return loc_reports.where(is_programming_language(F.col("language")))


def snapshot_loc(loc_reports: DataFrame) -> DataFrame:
    """Total counted lines per snapshot.

    The language rule sits inside the sum, not in a filter: a snapshot with other
    languages only must stay, with 0 lines, and not read as absent. A failed report
    is 0 lines as well.
    """
    lines = F.when(
        is_programming_language(F.col("language")) & (F.col("status") == OK), F.col("n_lines")
    )
    no_checkout = F.bool_or(F.col("status") == CHECKOUT_FAILED)
    tool_failed = F.bool_or(F.col("status") == TOOL_FAILED)
    status = F.when(no_checkout, CHECKOUT_FAILED).when(tool_failed, TOOL_FAILED).otherwise(OK)
    return (
        loc_reports.groupBy("project", "sha")
        .agg(status.alias("status"), F.coalesce(F.sum(lines), F.lit(0)).alias("_sum"))
        .select(
            "project",
            "sha",
            "status",
            F.when(F.col("status") == OK, F.col("_sum")).otherwise(0).cast("bigint").alias("loc"),
        )
    )


def _measured(status: Column) -> Column:
    # A snapshot nobody reported on counts as one that could not be checked out.
    return F.coalesce(status != CHECKOUT_FAILED, F.lit(False))


def loc_delta(commits: DataFrame, totals: DataFrame) -> DataFrame:
    """Absolute change of each commit against its first parent.

    ``previous_hash`` is set only where both snapshots were measured; elsewhere the
    change is 0. ``log_author`` is the author in the log in every case. Both joins
    read the same shuffle of ``totals``. These are unique per commit, so a parent with
    very many children skews the left side only, which can be split.
    """
    totals = forget_partitioning(totals, "sha")
    current = totals.select(
        "project", "sha", F.col("status").alias("_status"), F.col("loc").alias("_loc")
    )
    parent = totals.select(
        "project",
        F.col("sha").alias("_parent_key"),
        F.col("status").alias("_parent_status"),
        F.col("loc").alias("_parent_loc"),
    )
    log = commits.select(
        "project",
        "sha",
        F.col("author_name").alias("log_author"),
        first_parent(F.col("parents")).alias("_parent"),
    )
    both = (
        log.join(current, ["project", "sha"], "left")
        # Root commits look up themselves instead of all meeting at the NULL key.
        .withColumn("_parent_key", F.coalesce("_parent", "sha"))
        .join(parent, ["project", "_parent_key"], "left")
    )
    measured = (
        F.col("_parent").isNotNull() & _measured(F.col("_status")) & _measured(F.col("_parent_status"))
    )
    change = F.abs(F.col("_loc") - F.col("_parent_loc"))
    return both.select(
        "project",
        "sha",
        F.when(measured, F.col("_parent")).alias("previous_hash"),
        F.when(measured, change).otherwise(0).cast("bigint").alias("tloc"),
        "log_author",
    )


def tloc_report(listed: DataFrame, delta: DataFrame) -> DataFrame:
    """One row per listing. An unmeasured commit has no previous hash and no author."""
    joined = with_hash(listed).select("project", "sha").join(delta, ["project", "sha"], "left")
    return tloc_rows(joined)


def tloc_rows(credited: DataFrame, *order: str) -> DataFrame:
    """The report of listings that have met their change; ``order`` columns stay."""
    author = F.when(F.col("previous_hash").isNotNull(), F.col("log_author"))
    return credited.select(
        "project",
        *order,
        F.col("sha").alias("refactoring_hash"),
        or_default(F.col("previous_hash"), NO_HASH).alias("previous_hash"),
        or_default(author, UNKNOWN).alias("author"),
        F.coalesce("tloc", F.lit(0)).cast("bigint").alias("TLOC"),
    )
