"""The mining steps as Spark jobs over all projects at once.

Each job takes fact tables and writes its results under ``out``, partitioned by project.
Steps that another step builds on are written and read back, so a lost executor or a
restarted driver costs at most the step it was in.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import commits as C
from ..operators import diffs as D
from ..operators import effort as E
from ..operators import issues as I
from ..operators import loc as L
from ..operators import membership as M
from ..operators import projects as P
from ..operators import refactorings as R
from ..sources import writers as W
from ..sources.readers import finished_projects
from ..streaming import ingest_chunks, landed_commits

log = logging.getLogger(__name__)


def _timed(job: Callable) -> Callable:
    @wraps(job)
    def run(*args, **kwargs):
        start = time.time()
        result = job(*args, **kwargs)
        log.info("%s took %s", job.__name__, time.strftime("%H:%M:%S", time.gmtime(time.time() - start)))
        return result

    return run


def _done_projects(spark: SparkSession, path: str) -> DataFrame:
    """Projects with a result under ``path``; none before the first run.

    The names are in the folder names. Only files are listed; no result is read.
    """
    try:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", "part-*")
            .load(path)
        )
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "project string")
    folder = F.regexp_extract("path", "/project=([^/]+)/", 1)
    name = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
    return files.select(name.alias("project")).distinct()


def _store(df: DataFrame, path: str) -> DataFrame:
    """Write a shared intermediate result and go on from the written copy."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@_timed
def url_list(measures: DataFrame, out: str) -> None:
    """Project -> URL objects, and the names that could not be parsed."""
    W.write_urls(P.project_urls(measures), f"{out}/repos_urls")
    P.project_name_rejects(measures).write.mode("overwrite").json(f"{out}/rejected_names")


@_timed
def work_plan(commits: DataFrame, listed: DataFrame, out: str, size: int = C.CHUNK_SIZE) -> None:
    """Chunks of commits still to be analysed: bounds and members, oldest first."""
    pending = C.pending_commits(commits, C.analysed_commits(listed))
    bounds = C.chunk_bounds(C.commit_chunks(pending, size))
    bounds.hint("rebalance", "project").sortWithinPartitions("project", "chunk").write.mode(
        "overwrite"
    ).json(f"{out}/work_plan")


@_timed
def refactoring_results(
    spark: SparkSession,
    chunks: str,
    commits: DataFrame,
    projects: DataFrame,
    out: str,
    checkpoint: str | None = None,
    multi_line: bool = True,
) -> None:
    """Ingest new chunk files, then summarise the listed projects that have no summary yet."""
    landed = f"{out}/refactoring_commits"
    ingest_chunks(spark, chunks, landed, checkpoint, multi_line)
    wanted = projects.where("project <> ''")
    listed = M.listed_projects(landed_commits(spark, landed), wanted)
    summary_path = f"{out}/refactoring_summary"
    # The names still to do are narrow; a semi-join with them prunes the projects' folders.
    todo = M.only_in(listed, M.not_in(wanted, _done_projects(spark, summary_path)))
    # The done projects stay untouched and are not in ``todo``: adding is enough.
    W.write_refactoring_summary(R.refactoring_summary(todo, commits), summary_path, mode="append")
    R.typeless_refactorings(listed).write.mode("overwrite").json(f"{out}/rejected_refactorings")
    R.listed_without_time(listed, commits).write.mode("overwrite").json(f"{out}/rejected_commits")


@_timed
def diff_results(spark: SparkSession, commits: DataFrame, changes: DataFrame, out: str) -> None:
    """Diff records of the projects not yet finished, and the changes that cannot be used.

    Three sinks are written for the projects to do, each replacing only those projects'
    folders: rejects, changed files, commits. Then the projects enter the ledger
    ``commit_diffs/done``, also those without a changed file. A stop anywhere before the
    ledger leaves them to do; the rerun replaces whatever part was written, so each row is
    there once. Readers (``sources.readers.read_commit_diffs``) see only ledger projects, so
    files and commits of a project become visible together.
    """
    path = f"{out}/commit_diffs"
    names = commits.where("project <> ''").select("project").distinct()
    # Fixed before any write: the ledger this run adds to must not change what it does.
    todo = _store(M.not_in(names, finished_projects(spark, f"{path}/done")), f"{out}/diff_todo")
    fresh = M.only_in(changes, todo)
    named = _store(D.named_changes(fresh), f"{out}/named_changes")
    heads = _store(D.commit_heads(M.only_in(commits, todo), named), f"{out}/diff_heads")
    W.write_diff_rejects(D.file_change_rejects(fresh.drop("diff")), f"{out}/rejected_changes")
    W.write_commit_files(D.head_files(heads, named), path)
    W.write_commit_heads(heads, path)
    W.publish_done(todo, f"{path}/done", time.strftime("%Y%m%dT%H%M%S", time.gmtime()))


@_timed
def effort_results(commits: DataFrame, reports: DataFrame, listed: DataFrame, out: str) -> None:
    """LOC change report and both effort maps of the projects with refactoring results.

    Only listed commits are measured, and only reports of them and their first parents are
    totalled. Listings meet their change once; all three results come from that.
    """
    commit = ["project", "sha"]
    measured = M.only_in(commits, listed, commit)
    needed = measured.select(*commit).union(C.with_parent(measured).select("project", "previous_hash"))
    totals = L.snapshot_loc(M.only_in(reports, needed, commit))
    credited = _store(E.credited(listed, L.loc_delta(measured, totals)), f"{out}/credited")
    order = [c for c in E.LISTING_ORDER if c in credited.columns]
    W.write_tloc(L.tloc_rows(credited, *order), f"{out}/tloc")
    W.write_effort(E.author_effort(credited), E.type_effort(credited), f"{out}/effort")


@_timed
def issue_results(pages: DataFrame, probe: DataFrame, out: str) -> None:
    """All issues of the repositories that keep them with their host, and their numbers."""
    tracked = I.tracked_pages(pages, probe)
    W.write_issues(I.issues(tracked), f"{out}/issues")
    I.page_gaps(tracked).write.mode("overwrite").json(f"{out}/page_gaps")
    I.issue_counts(tracked).write.mode("overwrite").json(f"{out}/issue_counts")
    I.tracker_status(probe).where(F.col("tracker") != "github").write.mode("overwrite").json(
        f"{out}/untracked"
    )
