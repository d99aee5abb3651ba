"""Diff statistics per file and per commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import diff_content, lines_added, lines_deleted
from .commits import with_parent
from .membership import forget_partitioning, only_in


def diff_line_counts(file_changes: DataFrame) -> DataFrame:
    """Replace the diff text by its two line counts, before anything is shuffled."""
    return file_changes.select(
        "project",
        "sha",
        "pos",
        "filename",
        "change_type",
        lines_added(F.col("diff")).alias("lines_added"),
        lines_deleted(F.col("diff")).alias("lines_deleted"),
    )


_TOTALS = ["files_added", "files_deleted", "lines_added", "lines_deleted", "changed"]


def commit_diff_stats(file_changes: DataFrame) -> DataFrame:
    """Totals per commit over every changed file, same-named ones included."""
    return (
        diff_line_counts(usable_changes(file_changes))
        .groupBy("project", "sha")
        .agg(
            F.count_if(F.col("change_type") == "ADD").alias("files_added"),
            F.count_if(F.col("change_type") == "DELETE").alias("files_deleted"),
            F.sum("lines_added").alias("lines_added"),
            F.sum("lines_deleted").alias("lines_deleted"),
            F.count(F.lit(1)).alias("changed"),
        )
    )


def file_diffs(file_changes: DataFrame, content: bool = True) -> DataFrame:
    """One row per commit and file name: the last change wins, the first place stays.

    Without ``content`` only numbers are shuffled and the aggregate is a hash one.
    """
    change = usable_changes(file_changes).select(
        "project",
        "sha",
        "filename",
        "pos",
        lines_added(F.col("diff")).alias("lines_added"),
        lines_deleted(F.col("diff")).alias("lines_deleted"),
        *([diff_content(F.col("diff")).alias("diff_content")] if content else []),
    )
    kept = ["lines_added", "lines_deleted", *(["diff_content"] if content else [])]
    return change.groupBy("project", "sha", "filename").agg(
        F.min("pos").alias("pos"), *[F.max_by(c, "pos").alias(c) for c in kept]
    )


def usable_changes(file_changes: DataFrame) -> DataFrame:
    """Changes that name their commit, place and file; the others are rejects."""
    return file_changes.where(
        "project is not null and sha is not null and pos is not null and filename is not null"
    )


def file_change_rejects(file_changes: DataFrame) -> DataFrame:
    """Nameless changes, and places that several changes claim, without their texts.

    Changes at one place are all used, in the order of a digest of what they say.
    """
    nameless = (
        file_changes.where("project is null or sha is null or pos is null or filename is null")
        .groupBy("project", "sha", "pos")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("reason", F.lit("nameless"))
    )
    repeated = (
        usable_changes(file_changes)
        .groupBy("project", "sha", "pos")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .withColumn("reason", F.lit("repeated position"))
    )
    return nameless.unionByName(repeated)


def named_changes(file_changes: DataFrame) -> DataFrame:
    """One row per commit and file name with all that a commit's record needs.

    The last change's text and counts win, the first place stays, and what all changes of
    the name add to the commit's totals is summed. The text is read and shuffled once.
    """
    change = usable_changes(file_changes).select(
        "project",
        "sha",
        "filename",
        "pos",
        "change_type",
        lines_added(F.col("diff")).alias("lines_added"),
        lines_deleted(F.col("diff")).alias("lines_deleted"),
        diff_content(F.col("diff")).alias("diff_content"),
    )
    tie = F.xxhash64("change_type", "diff_content").alias("tie")
    return (
        change.groupBy("project", "sha", "filename")
        .agg(
            F.min("pos").alias("pos"),
            F.max(F.struct("pos", tie, "lines_added", "lines_deleted", "diff_content")).alias("last"),
            F.count_if(F.col("change_type") == "ADD").alias("_files_added"),
            F.count_if(F.col("change_type") == "DELETE").alias("_files_deleted"),
            F.sum("lines_added").alias("_lines_added"),
            F.sum("lines_deleted").alias("_lines_deleted"),
            F.count(F.lit(1)).alias("_changed"),
        )
        .select(
            "project", "sha", "pos", "filename", "last.diff_content", "last.lines_added",
            "last.lines_deleted", *[f"_{c}" for c in _TOTALS],
        )
    )


def commit_heads(commits: DataFrame, named: DataFrame) -> DataFrame:
    """Every commit with a parent and at least one changed file, with its totals."""
    totals = named.groupBy("project", "sha").agg(*[F.sum(f"_{c}").alias(c) for c in _TOTALS])
    described = with_parent(commits).select(
        "project",
        "sha",
        "pos",
        F.col("previous_hash").alias("previous_commit_hash"),
        F.col("author_name").alias("author"),
        F.col("author_date").alias("date"),
        "message",
    )
    return described.join(forget_partitioning(totals, "project", "sha"), ["project", "sha"]).select(
        "project", F.col("sha").alias("commit_hash"), *described.columns[2:], *_TOTALS
    )


def head_files(heads: DataFrame, named: DataFrame) -> DataFrame:
    """Changed files of the commits that have a head, in the flat shape of the sink."""
    files = named.select(
        "project", F.col("sha").alias("commit_hash"), F.col("pos").alias("file_pos"), "filename",
        "diff_content", "lines_added", "lines_deleted",
    )
    return only_in(files, heads, ["project", "commit_hash"])


def nested_records(heads: DataFrame, files: DataFrame) -> DataFrame:
    """A view for callers who want one nested record per commit, whatever its size."""
    diff = F.struct("diff_content", "lines_added", "lines_deleted")
    maps = (
        files.groupBy("project", "commit_hash")
        .agg(F.array_sort(F.collect_list(F.struct("file_pos", "filename", diff.alias("diff")))).alias("f"))
        .select(
            "project",
            "commit_hash",
            F.map_from_entries(
                F.transform("f", lambda x: F.struct(x["filename"], x["diff"]))
            ).alias("file_diffs"),
        )
    )
    return heads.join(maps, ["project", "commit_hash"]).select(
        *[c for c in heads.columns if c not in _TOTALS],
        F.struct(*_TOTALS, "file_diffs").alias("diff_stats"),
    )
