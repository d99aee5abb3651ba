"""Project names, URLs and slices of the work list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import project_field, repo_url
from .ordering import with_row_index


def project_names(measures: DataFrame) -> DataFrame:
    """Distinct project names with the position of their first row."""
    return (
        measures.select(project_field(F.col("_c0")).alias("project"), "pos")
        .where("project is not null and project <> ''")
        .groupBy("project")
        .agg(F.min("pos").alias("pos"))
    )


def project_urls(measures: DataFrame) -> DataFrame:
    """Project, URL and position; names with more than one ``_`` are left to the rejects."""
    return (
        project_names(measures)
        .select("project", repo_url(F.col("project")).alias("url"), "pos")
        .where("url is not null")
    )


def project_name_rejects(measures: DataFrame) -> DataFrame:
    return project_names(measures).where(repo_url(F.col("project")).isNull())


def project_slice(projects: DataFrame, start: int = 0, amount: int | None = None) -> DataFrame:
    """``amount`` projects from the ``start``-th on, in list order.

    Rows are numbered block by block instead of sorted to an offset, so a slice far
    into a long list is as distributed as one at its head.
    """
    numbered = with_row_index(projects, [], "pos", "idx", ties=["project"])
    kept = F.col("idx") >= start
    if amount is not None:
        kept = kept & (F.col("idx") < start + amount)
    return numbered.where(kept)
