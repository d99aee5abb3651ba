"""Registered queries: each runs one operator over the views of ``tables``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.operators import commits as C
from chronolode.operators import diffs as D
from chronolode.operators import effort as E
from chronolode.operators import issues as I
from chronolode.operators import loc as L
from chronolode.operators import membership as M
from chronolode.operators import projects as P
from chronolode.operators import refactorings as R
from chronolode.session import shared_dir
from chronolode.plans import jobs
from chronolode.sources import readers, writers
from chronolode.streaming import ingest_chunks, landed_commits

from . import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _delta(spark: SparkSession, sf: str) -> DataFrame:
    return L.loc_delta(t.commits(spark, sf), L.snapshot_loc(t.loc_reports(spark, sf)))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Lines of code and effort


@query
def programming_rows(spark, sf):
    return L.programming_rows(t.loc_reports(spark, sf))


@query
def snapshot_loc(spark, sf):
    return L.snapshot_loc(t.loc_reports(spark, sf))


@query
def commit_parents(spark, sf):
    return C.with_parent(t.commits(spark, sf)).select("project", "sha", "previous_hash")


@query
def loc_delta(spark, sf):
    return _delta(spark, sf)


@query
def tloc_report(spark, sf):
    return L.tloc_report(t.listed(spark, sf), _delta(spark, sf))


@query
def resolved_authors(spark, sf):
    return E.resolved_authors(t.listed(spark, sf), t.commits(spark, sf))


@query
def effort_by_author(spark, sf):
    return E.effort_by_author(t.listed(spark, sf), _delta(spark, sf))


@query
def effort_by_type(spark, sf):
    return E.effort_by_type(t.listed(spark, sf), _delta(spark, sf))


@query
def effort_objects(spark, sf):
    """Both effort maps as rows, from listings that met their change once."""
    credited = _stored(E.credited(t.listed(spark, sf), _delta(spark, sf)), "credited")
    return writers.effort_rows(E.author_effort(credited), E.type_effort(credited))


# Refactorings


@query
def refactoring_counts(spark, sf):
    return R.refactoring_counts(t.listed(spark, sf))


@query
def typeless_refactorings(spark, sf):
    return R.typeless_refactorings(t.listed(spark, sf))


@query
def refactoring_total(spark, sf):
    return R.refactoring_total(t.listed(spark, sf))


@query
def commit_times(spark, sf):
    times = R.listed_times(t.listed(spark, sf), t.commits(spark, sf))
    return times.select("project", "sha", F.unix_seconds("committer_ts").alias("secs"), "n")


@query
def listed_without_time(spark, sf):
    head = t.commits(spark, sf).where("on_head")
    return R.listed_without_time(t.listed(spark, sf), head).select("project", "sha", "author")


@query
def mean_gap(spark, sf):
    return R.refactoring_gap(t.listed(spark, sf), t.commits(spark, sf))


@query
def refactoring_summary(spark, sf):
    summary = R.refactoring_summary(t.listed(spark, sf), t.commits(spark, sf))
    return summary.withColumn("counts", F.to_json("counts"))


@query
def incremental_ingest(spark, sf):
    """Land the listings as chunk documents in two goes and ingest after each."""
    run = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    commit = F.struct(F.col("sha").alias("sha1"), "authorName", "author", "refactorings")
    listed = t.listed(spark, sf)
    first = F.coalesce(F.col("l_linestatus") == "O", F.lit(False))
    for half in (first, ~first):
        # A listing is its own document: no group of lines is gathered for a file.
        (
            listed.where(half)
            .select("project", F.to_json(F.struct(F.array(commit).alias("commits"))).alias("value"))
            .hint("rebalance", "project")
            .write.mode("append")
            .partitionBy("project")
            .text(f"{run}/chunks")
        )
        ingest_chunks(
            spark, f"{run}/chunks", f"{run}/landed", f"{run}/checkpoint", multi_line=False
        )
    landed = landed_commits(spark, f"{run}/landed")
    n = F.when(F.col("refactorings").isNull(), 0).otherwise(F.size("refactorings"))
    return landed.select(
        "project", "sha", "authorName", "author", n.cast("bigint").alias("n_refactorings")
    )


# Diffs


@query
def diff_line_counts(spark, sf):
    return D.diff_line_counts(t.file_changes(spark, sf))


@query
def commit_diff_stats(spark, sf):
    return D.commit_diff_stats(t.file_changes(spark, sf))


@query
def file_diff_last_wins(spark, sf):
    return D.file_diffs(t.file_changes(spark, sf))


@query
def file_diff_numbers(spark, sf):
    return D.file_diffs(t.file_changes(spark, sf), content=False)


@query
def commit_diff_records(spark, sf):
    """The two flat tables of the sink, joined: a row per commit and changed file."""
    named = _stored(D.named_changes(t.file_changes(spark, sf)), "named")
    heads = D.commit_heads(t.commits(spark, sf), named)
    files = D.head_files(heads, named)
    totals = {"lines_added": "lines_added_in_all", "lines_deleted": "lines_deleted_in_all"}
    return heads.withColumnsRenamed(totals).join(files, ["project", "commit_hash"])


@query
def diff_job_published(spark, sf):
    """The diff job run in two goes over all projects, its sink read back as published.

    The same rows as ``commit_diff_records`` for every named project: each go writes its
    projects' rejects, files and commits, then their ledger entries; the reader joins the
    two tables of the projects in the ledger.
    """
    out = _folder(spark, "diff-job")
    commits, changes = t.commits(spark, sf), t.file_changes(spark, sf)
    first = F.coalesce(F.xxhash64("project") % 2 == 0, F.lit(False))
    for part in (first, ~first):
        jobs.diff_results(spark, commits.where(part), changes, out)
    schema = D.commit_heads(commits, D.named_changes(changes)).schema
    heads, files = readers.read_commit_diffs(spark, f"{out}/commit_diffs", schema)
    totals = {"lines_added": "lines_added_in_all", "lines_deleted": "lines_deleted_in_all"}
    return heads.withColumnsRenamed(totals).join(files, ["project", "commit_hash"])


@query
def file_change_rejects(spark, sf):
    """Every tenth name blanked and some places claimed twice."""
    changes = t.file_changes(spark, sf)
    spoilt = changes.withColumn("filename", F.when(F.col("pos") % 10 != 3, F.col("filename"))).withColumn(
        "pos", F.when(F.col("pos") % 7 == 1, F.col("pos") - 1).otherwise(F.col("pos"))
    )
    return D.file_change_rejects(spoilt)


# Sources and sinks: written through the sink (or as the tools leave them), read back


def _landed_json(df: DataFrame, name: str) -> str:
    """JSON lines of a view with a broken line after each tenth or so."""
    path = _folder(df.sparkSession, name)
    whole = F.to_json(F.struct(*df.columns))
    broken = F.when(F.xxhash64(whole) % 10 == 0, F.concat(F.lit('{"cut": "'), F.lit("x")))
    df.select(F.explode(F.array_compact(F.array(whole, broken))).alias("value")).write.text(path)
    return path


@query
def file_changes_read(spark, sf):
    path = _landed_json(t.file_changes(spark, sf), "file_changes")
    return readers.read_file_changes(spark, path, "json")[0]


@query
def commits_read(spark, sf):
    log = t.commits(spark, sf)
    padded = log.withColumn("sha", F.when(F.col("pos") % 9 != 4, F.concat(F.lit(" "), "sha", F.lit("\n"))).otherwise(" "))
    path = _landed_json(padded.drop("author_ts", "author_tz", "committer_ts"), "commits")
    ok, _ = readers.read_commits(spark, path, "json")
    return ok.select("project", "sha", "pos", "author_tz", F.unix_seconds("author_ts").alias("secs"))


@query
def loc_reports_read(spark, sf):
    """Reports as rows; the named ones are totalled."""
    path = _landed_json(t.loc_reports(spark, sf), "loc_reports")
    return L.snapshot_loc(readers.read_loc_table(spark, path, "json")[0])


@query
def issue_pages_read(spark, sf):
    path = _landed_json(t.issue_pages(spark, sf), "issue_pages")
    pages, _ = readers.read_issue_pages(spark, path)
    return I.with_item_count(pages).select("owner", "repo", F.col("page").cast("long"), "status", "n_items")


@query
def refactoring_commits_read(spark, sf):
    path = _folder(spark, "listed")
    writers.write_refactoring_commits(t.listed(spark, sf).drop("l_returnflag", "l_linestatus"), path, "json")
    listed, _ = readers.read_refactoring_commits(spark, path, "json")
    n = F.when(F.col("refactorings").isNull(), 0).otherwise(F.size("refactorings"))
    return listed.select("project", "sha", "authorName", "author", n.cast("bigint").alias("n_refactorings"))


@query
def tloc_written(spark, sf):
    path = _folder(spark, "tloc")
    writers.write_tloc(L.tloc_report(t.listed(spark, sf), _delta(spark, sf)), path)
    columns = "refactoring_hash string, previous_hash string, author string, TLOC bigint, project string"
    report = spark.read.schema(columns).option("header", True).option("escape", '"').csv(path)
    return report.select("project", "refactoring_hash", "previous_hash", "author", "TLOC")


@query
def effort_written(spark, sf):
    path = _folder(spark, "effort")
    credited = _stored(E.credited(t.listed(spark, sf), _delta(spark, sf)), "credited")
    writers.write_effort(E.author_effort(credited), E.type_effort(credited), path)
    return spark.read.schema("project string, map string, key string, effort bigint").json(path)


@query
def urls_written(spark, sf):
    path = _folder(spark, "urls")
    writers.write_urls(P.project_urls(t.measures(spark, sf)), path)
    return spark.read.schema("project string, url string, pos bigint").json(path)


@query
def issues_written(spark, sf):
    """Issues in the order of their files: the place of each in its repository's list."""
    path = _folder(spark, "issues")
    pages = I.tracked_pages(t.issue_pages(spark, sf), t.issue_probe(spark, sf))
    writers.write_issues(I.issues(pages), path)
    return spark.read.schema("value string, owner string, repo string").text(path)


# Work planning


@query
def analysed_commits(spark, sf):
    return C.analysed_commits(t.analysed_listings(spark, sf))


def _pending(spark, sf):
    return C.pending_commits(t.commits(spark, sf), t.analysed_listings(spark, sf))


@query
def pending_commits(spark, sf):
    return C.oldest_first(_pending(spark, sf)).select("project", "sha", "pos")


@query
def commit_chunks(spark, sf):
    return C.commit_chunks(_pending(spark, sf))


@query
def chunk_bounds(spark, sf):
    bounds = C.chunk_bounds(C.commit_chunks(_pending(spark, sf)))
    return bounds.withColumn("members", F.array_join("members", ","))


@query
def commits_newest_first(spark, sf):
    return C.newest_first(t.commits(spark, sf)).select(
        "project", "sha", "pos", "author_tz", F.unix_seconds("author_ts").alias("authored")
    )


@query
def listed_projects(spark, sf):
    listed = M.listed_projects(
        t.commits(spark, sf), t.projects(spark, sf).where("n_regionkey <> 2")
    )
    return listed.select("project", "sha")


@query
def unprocessed_projects(spark, sf):
    done = t.projects(spark, sf).where("n_regionkey = 0")
    return M.unprocessed_projects(t.commits(spark, sf), done).select("project", "sha")


@query
def projects_with_results(spark, sf):
    return M.projects_with_results(t.projects(spark, sf), t.listed(spark, sf)).select("project")


# Projects


@query
def project_urls(spark, sf):
    return P.project_urls(t.measures(spark, sf))


@query
def project_name_rejects(spark, sf):
    return P.project_name_rejects(t.measures(spark, sf))


@query
def project_slice(spark, sf):
    return P.project_slice(P.project_urls(t.measures(spark, sf)), 10, 7).select(
        "idx", "project", "url"
    )


@query
def url_objects(spark, sf):
    return writers.url_objects(P.project_urls(t.measures(spark, sf)))


# Issues


@query
def tracker_status(spark, sf):
    return I.tracker_status(t.issue_probe(spark, sf))


@query
def issue_pages_kept(spark, sf):
    pages = I.with_item_count(t.issue_pages(spark, sf))
    return I.collect_pages(pages).select("owner", "repo", "page", "n_items")


@query
def issues(spark, sf):
    pages = I.tracked_pages(t.issue_pages(spark, sf), t.issue_probe(spark, sf))
    return I.issues(pages)


@query
def page_gaps(spark, sf):
    return I.page_gaps(t.issue_pages(spark, sf))


@query
def issue_counts(spark, sf):
    return I.issue_counts(t.issue_pages(spark, sf))
