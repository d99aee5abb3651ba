"""Issue pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .membership import forget_partitioning, not_in, only_in

PAGE_SIZE = 100
_REPO = ["owner", "repo"]


def tracker_status(probe: DataFrame) -> DataFrame:
    """``github`` when the probe found issues, ``none`` on 404, else ``error``."""
    tracker = (
        F.when(F.col("status") == 404, "none")
        .when((F.col("status") == 200) & (F.col("n_items") > 0), "github")
        .otherwise("error")
    )
    return probe.select(*_REPO, tracker.alias("tracker"))


def tracked_pages(pages: DataFrame, probe: DataFrame) -> DataFrame:
    """Pages of the repositories whose probe found issues."""
    return only_in(pages, tracker_status(probe).where("tracker = 'github'"), _REPO)


def with_item_count(pages: DataFrame) -> DataFrame:
    n = F.when(F.col("issues").isNull(), 0).otherwise(F.size("issues"))
    return pages.withColumn("n_items", n.cast("bigint"))


def page_gaps(pages: DataFrame) -> DataFrame:
    """Repositories with a missing page: the first page after the first gap.

    Pages count from 1. A page begins a run if the one before it is absent; the lowest
    such page other than 1 lies behind the gap. Only narrow keys are shuffled.
    """
    there = pages.select(*_REPO, F.col("page").cast("long").alias("page")).where("page >= 1").distinct()
    follows = there.select(*_REPO, (F.col("page") + 1).alias("page"))
    return (
        not_in(there.where("page > 1"), follows, [*_REPO, "page"])
        .groupBy(*_REPO)
        .agg(F.min("page").alias("behind_gap"))
    )


def mark_pages(pages: DataFrame, full: int = PAGE_SIZE) -> DataFrame:
    """Flag the pages up to the first bad, empty, short or missing one as ``kept``.

    Only a short page is itself kept. Where a repository stops is the lowest such
    page, an aggregate that combines on the map side. No window runs over a
    repository, and the issue texts are never sorted.
    """
    good = F.coalesce((F.col("status") == 200) & (F.col("n_items") > 0), F.lit(False))
    stops = (
        pages.where(~good | (F.col("n_items") < full))
        .select(*_REPO, F.col("page").cast("long").alias("_stop"))
        .unionByName(page_gaps(pages).select(*_REPO, (F.col("behind_gap") - 1).alias("_stop")))
        .groupBy(*_REPO)
        .agg(F.min("_stop").alias("_stop"))
    )
    before = F.col("_stop").isNull() | (F.col("page") <= F.col("_stop"))
    stops = forget_partitioning(stops, *_REPO)
    return (
        pages.join(stops, _REPO, "left")
        .withColumn("kept", good & before & (F.col("page") >= 1))
        .drop("_stop")
    )


def collect_pages(pages: DataFrame, full: int = PAGE_SIZE) -> DataFrame:
    return mark_pages(pages, full).where("kept").drop("kept")


def issues(pages: DataFrame, full: int = PAGE_SIZE) -> DataFrame:
    """Every issue of the kept pages; (page, pos) is its place in the repository."""
    return collect_pages(with_item_count(pages), full).select(
        *_REPO, "page", F.posexplode("issues").alias("pos", "issue")
    )


def issue_counts(pages: DataFrame, full: int = PAGE_SIZE) -> DataFrame:
    """Issues per repository, 0 included; the texts are dropped before the join."""
    counted = with_item_count(pages).select(*_REPO, "page", "status", "n_items")
    n = F.when(F.col("kept"), F.col("n_items")).otherwise(0)
    return (
        mark_pages(counted, full).groupBy(*_REPO).agg(F.sum(n).cast("bigint").alias("n_issues"))
    )
