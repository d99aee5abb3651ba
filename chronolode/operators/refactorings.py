"""Refactoring analytics.

``listed`` is the table of refactoring commits: one row per listing, hashes may
repeat, and every listing counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import half_even_seconds
from .membership import not_in


def first_listings(listed: DataFrame, *order: str) -> DataFrame:
    """The first listing of each hash."""
    rest = [c for c in listed.columns if c not in ("project", "sha")]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    return listed.groupBy("project", "sha").agg(first).select("project", "sha", "first.*")


LISTING = ["sha", "authorName", "author", "refactorings"]


def listing_fields(commit: str) -> list[Column]:
    """Columns of one listing out of a chunk's commit struct."""
    return [F.col(f"{commit}.sha1").alias("sha"), *[F.col(f"{commit}.{c}") for c in LISTING[1:]]]


def merge_chunks(chunk_files: DataFrame, dedup: bool = False) -> DataFrame:
    """All commits of all valid chunk files; hashes repeat unless ``dedup``."""
    listed = chunk_files.select(
        "project", "file", F.posexplode("commits").alias("pos", "c")
    ).select("project", *listing_fields("c"), "file", "pos")
    return first_listings(listed, "file", "pos") if dedup else listed


def refactoring_counts(listed: DataFrame) -> DataFrame:
    """Refactorings per project and type."""
    return (
        listed.select("project", F.explode("refactorings.type").alias("type"))
        .where("type is not null")
        .groupBy("project", "type")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def typeless_refactorings(listed: DataFrame) -> DataFrame:
    """Rejects: refactorings that name no type."""
    return (
        listed.select("project", "sha", F.explode("refactorings.type").alias("type"))
        .where("type is null")
        .select("project", "sha")
    )


def refactoring_total(listed: DataFrame) -> DataFrame:
    """Typed refactorings per project, 0 included."""
    typed = F.size(F.array_compact("refactorings.type"))
    typed = F.when(F.col("refactorings").isNull(), 0).otherwise(typed)
    return listed.groupBy("project").agg(F.sum(typed).cast("bigint").alias("total"))


def _listings(listed: DataFrame) -> DataFrame:
    # One row per hash before any join: a hash listed very often costs no more
    # than any other.
    return listed.groupBy("project", "sha").agg(F.count(F.lit(1)).alias("n"))


def listed_times(listed: DataFrame, commits: DataFrame) -> DataFrame:
    """Committer time of each listed hash and how often it is listed."""
    times = commits.select("project", "sha", "committer_ts").where("committer_ts is not null")
    return _listings(listed).join(times, ["project", "sha"])


def listed_without_time(listed: DataFrame, commits: DataFrame) -> DataFrame:
    """Rejects: listings whose hash has no time in the log."""
    timed = commits.where("committer_ts is not null")
    return not_in(listed, timed, ("project", "sha"))


def mean_gap_seconds(
    df: DataFrame, ts: str, by: Sequence[str], n: Column | None = None
) -> DataFrame:
    """Mean time between consecutive rows in whole seconds, 0 below two rows.

    The gaps between sorted times add up to last minus first, so neither a sort
    nor a window is needed. ``n`` is how many rows a row stands for.
    """
    n = F.lit(1) if n is None else n
    at = F.unix_micros(F.col(ts))
    return (
        df.groupBy(*by)
        .agg(
            (F.max(at) - F.min(at)).alias("_span"),
            F.sum(F.when(F.col(ts).isNotNull(), n)).alias("_rows"),
        )
        .select(*by, half_even_seconds(F.col("_span"), F.col("_rows") - 1).alias("avg_time"))
    )


def refactoring_gap(listed: DataFrame, commits: DataFrame) -> DataFrame:
    """Mean gap over all listings of a project, with or without refactorings."""
    return mean_gap_seconds(listed_times(listed, commits), "committer_ts", ["project"], F.col("n"))


def refactoring_summary(listed: DataFrame, commits: DataFrame) -> DataFrame:
    """``counts``, ``total`` and ``avg_time`` of every project that lists a commit.

    ``counts`` holds one entry per refactoring type, a vocabulary fixed by the
    detector, so the collected list does not grow with the data.
    """
    entry = F.when(F.col("type").isNotNull(), F.struct("type", "n"))
    counts = (
        listed.select("project", F.explode_outer("refactorings.type").alias("type"))
        .groupBy("project", "type")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("project")
        .agg(
            F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("counts"),
            F.coalesce(F.sum(F.when(F.col("type").isNotNull(), F.col("n"))), F.lit(0)).alias("total"),
        )
    )
    return counts.join(refactoring_gap(listed, commits), "project", "left").select(
        "project", "counts", "total", F.coalesce("avg_time", F.lit(0)).alias("avg_time")
    )
