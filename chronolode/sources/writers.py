"""Writers (K1-K7).

Sinks hold flat rows, one for each URL, changed file, author or issue, in the same shape at
every size; nested objects are views for callers who ask for them. Where a list has an order,
rows are range-partitioned and sorted by it, so the files in name order are the list.

A large project must not become one file written by one task, and a small one must
not become a file per task. ``rebalance`` leaves that to the adaptive planner, which
splits big projects and joins small ones by measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from ..operators.effort import LISTING_ORDER
from ..operators.membership import forget_partitioning

# Entries in one object of the object views.
ENTRIES_PER_OBJECT = 1000


def _partitioned(df: DataFrame, mode: str, *by: str) -> DataFrameWriter:
    # Overwriting replaces only the projects a job produced.
    return df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by)


def _by_project(df: DataFrame, mode: str) -> DataFrameWriter:
    return _partitioned(df.hint("rebalance", "project"), mode, "project")


def object_parts(
    df: DataFrame, by: str, key: str, value: str, name: str, limit: int = ENTRIES_PER_OBJECT
) -> DataFrame:
    """Maps ``key -> value`` per ``by`` in objects of about ``limit`` entries.

    A project with a million authors becomes a thousand objects whose union is its
    map; an ordinary project stays one object.
    """
    parts = df.groupBy(by).agg(F.expr(f"1 + (count(1) - 1) div {int(limit)}").alias("_parts"))
    return (
        forget_partitioning(df.join(forget_partitioning(parts, by), by), by)
        .withColumn("part", F.pmod(F.xxhash64(key), F.col("_parts")))
        .groupBy(by, "part")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))
    )


def url_objects(urls: DataFrame, limit: int = ENTRIES_PER_OBJECT) -> DataFrame:
    """Project -> URL as JSON objects in list order, ``limit`` positions each."""
    in_order = F.array_sort(F.collect_list(F.struct("pos", "project", "url")))
    entries = F.transform(in_order, lambda e: F.struct(e["project"], e["url"]))
    return (
        urls.groupBy(F.expr(f"pos div {int(limit)}").alias("part"))
        .agg(F.map_from_entries(entries).alias("urls"))
        .select("part", F.to_json("urls").alias("value"))
    )


def write_urls(urls: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One row per project in list order."""
    urls.select("pos", "project", "url").orderBy("pos", "project").write.mode(mode).json(path)


def write_refactoring_commits(
    listed: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite"
) -> None:
    _by_project(listed, mode).format(fmt).save(path)


def write_refactoring_summary(summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    _by_project(summary, mode).json(path)


def write_commit_files(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Changed files with their place; overwriting replaces only the projects written."""
    _by_project(files, mode).parquet(f"{path}/files")


def write_commit_heads(heads: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Commits with their place and totals; overwriting replaces only the projects written."""
    _by_project(heads, mode).json(f"{path}/commits")


def write_commit_diffs(
    heads: DataFrame, files: DataFrame, path: str, mode: str = "overwrite"
) -> None:
    """Changed files with their place, then commits with theirs and their totals.

    Neither is published before the projects enter the ledger (``publish_done``).
    """
    write_commit_files(files, path, mode)
    write_commit_heads(heads, path, mode)


def write_diff_rejects(rejects: DataFrame, path: str) -> None:
    """Changes that cannot be used, by project; a rerun replaces a project's rejects."""
    _by_project(rejects, "overwrite").json(path)


def publish_done(projects: DataFrame, path: str, run: str) -> None:
    """Add projects to the ledger of finished ones: the commit marker of a job's sinks.

    One small file of names per run; a project whose sinks were all written is in it, with
    or without result rows. Written last, so a stop before it leaves the projects to do.
    """
    projects.select("project").withColumn("run", F.lit(run)).coalesce(1).write.mode(
        "append"
    ).parquet(path)


def write_tloc(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV rows; a report that knows its listings' places is written in their order."""
    columns = ["refactoring_hash", "previous_hash", "author", "TLOC"]
    order = ["project", *(c for c in LISTING_ORDER if c in report.columns)]
    if len(order) > 1:
        placed = report.repartitionByRange(*order).sortWithinPartitions(*order)
        sink = _partitioned(placed.select("project", *columns), mode, "project")
    else:
        sink = _by_project(report.select("project", *columns), mode)
    (
        sink
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def effort_objects(by_author: DataFrame, by_type: DataFrame) -> DataFrame:
    """The two effort maps of each project, one object per part."""
    authors = object_parts(by_author, "project", "author", "effort", "developer_effort")
    types = object_parts(by_type, "project", "type", "effort", "refactoring_effort")
    return authors.join(types, ["project", "part"], "full")


def effort_rows(by_author: DataFrame, by_type: DataFrame) -> DataFrame:
    """Both effort maps as rows: which map, key and effort."""
    authors = by_author.select(
        "project", F.lit("author").alias("map"), F.col("author").alias("key"), "effort"
    )
    types = by_type.select(
        "project", F.lit("type").alias("map"), F.col("type").alias("key"), "effort"
    )
    return authors.unionByName(types)


def write_effort(
    by_author: DataFrame, by_type: DataFrame, path: str, mode: str = "overwrite"
) -> None:
    _by_project(effort_rows(by_author, by_type), mode).json(path)


def write_issues(issues: DataFrame, path: str, mode: str = "overwrite") -> None:
    """All issues of all repositories, each as the JSON text it came as, in page order."""
    place = ["owner", "repo", "page", "pos"]
    ordered = issues.repartitionByRange(*place).sortWithinPartitions(*place)
    _partitioned(ordered.select("owner", "repo", "issue"), mode, "owner", "repo").text(path)
