"""Effort by author and by refactoring type.

Listings are shuffled once, to the LOC change of their commit. The change is unique per
commit, so a commit listed very often skews the listings only, which can be split, and
both sums combine on the map side before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import or_default, resolve_author, stated_author
from ..functions.authors import UNKNOWN
from .membership import with_hash

_COMMIT = ["project", "sha"]
# Columns that, if present, give the place of a listing among all.
LISTING_ORDER = ("batch", "file", "pos")


def resolved_authors(listed: DataFrame, commits: DataFrame) -> DataFrame:
    """Author of every listing: as listed, else from the log, else unknown."""
    log = commits.select("project", "sha", F.col("author_name").alias("log_author"))
    return (
        with_hash(listed)
        .select("project", "sha", "authorName", "author")
        .join(log, _COMMIT, "left")
        .select(
            "project",
            "sha",
            resolve_author(F.col("authorName"), F.col("author"), F.col("log_author")).alias("author"),
        )
    )


def credited(listed: DataFrame, delta: DataFrame) -> DataFrame:
    """Every listing with the change of its commit: what all three results are made of.

    Columns that give a listing's place stay.
    """
    return (
        with_hash(listed)
        .select(
            "project",
            "sha",
            *(c for c in LISTING_ORDER if c in listed.columns),
            stated_author(F.col("authorName"), F.col("author")).alias("stated"),
            F.col("refactorings.type").alias("types"),
        )
        .join(delta, _COMMIT, "left")
    )


def author_effort(credited: DataFrame) -> DataFrame:
    author = or_default(F.coalesce("stated", "log_author"), UNKNOWN)
    return credited.groupBy("project", author.alias("author")).agg(
        F.coalesce(F.sum("tloc"), F.lit(0)).alias("effort")
    )


def type_effort(credited: DataFrame) -> DataFrame:
    return (
        credited.select("project", F.explode("types").alias("type"), "tloc")
        .where("type is not null")
        .groupBy("project", "type")
        .agg(F.coalesce(F.sum("tloc"), F.lit(0)).alias("effort"))
    )


def effort_by_author(listed: DataFrame, delta: DataFrame) -> DataFrame:
    """Change of all listed commits per author. A commit counts once per listing."""
    return author_effort(credited(listed, delta))


def effort_by_type(listed: DataFrame, delta: DataFrame) -> DataFrame:
    """Each refactoring credits its type with the whole change of its commit.

    Listings without refactorings stay out of the shuffle, and the others travel as one
    row each: they are taken apart only after they have met their change.
    """
    return type_effort(credited(listed.where("size(refactorings) > 0"), delta))
