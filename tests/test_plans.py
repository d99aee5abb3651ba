"""Physical plans: what reaches the scan, what shuffles, and that all work stays in the JVM."""

import re

import pytest

from checks import tables as t
from checks.queries import QUERIES
from chronolode.functions import PROGRAMMING_LANGUAGES
from chronolode.operators import diffs as D
from chronolode.operators import effort as E
from chronolode.operators import issues as I
from chronolode.operators import loc as L
from chronolode.operators import membership as M
from chronolode.operators import refactorings as R
from chronolode.sources.writers import object_parts

SF = "/root/testdata/sf0.001"
# These two write and read files; their own plans are covered by the file tests.
PLANNED = [n for n in QUERIES if n != "incremental_ingest"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("landed"))
    for name in ("commits", "listed", "loc_reports", "file_changes"):
        getattr(t, name)(spark, SF).write.parquet(f"{root}/{name}")
    return lambda name: spark.read.parquet(f"{root}/{name}")


@pytest.mark.parametrize("name", PLANNED)
def test_no_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for slow in ("EvalPython", "InPandas", "pythonUDF", "CartesianProduct", "NestedLoopJoin"):
        assert slow not in text


@pytest.mark.parametrize("name", PLANNED)
def test_windows_run_over_blocks_only(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for window in re.findall(r"Window \[(.*)", text):
        # Either inside a block of positions or over one row per block.
        assert "_block" in window


def test_language_filter_reaches_the_scan(landed):
    text = plan(L.programming_rows(landed("loc_reports")))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "In(language" in pushed
    assert all(language in pushed for language in PROGRAMMING_LANGUAGES)


def test_only_refactoring_types_are_read(landed):
    text = plan(R.refactoring_counts(landed("listed")))
    assert "ReadSchema: struct<project:string,refactorings:array<struct<type:string>>>" in text


def test_diff_text_stays_out_of_the_shuffle(landed):
    text = plan(D.commit_diff_stats(landed("file_changes")))
    assert text.count("Exchange") == 1
    above = text[: text.index("Exchange")] + text[text.index("Exchange") :].split("\n")[0]
    assert "diff#" not in above
    numbers = plan(D.file_diffs(landed("file_changes"), content=False))
    assert "SortAggregate" not in numbers


def test_both_lookups_of_totals_share_one_scan_and_shuffle(spark, landed):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = L.loc_delta(landed("commits"), L.snapshot_loc(landed("loc_reports")))
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("ReusedExchange") == 1
    assert text.count("FileScan") == 2


def test_report_reads_no_unused_column(landed):
    text = plan(L.snapshot_loc(landed("loc_reports")).select("project", "sha"))
    assert "n_lines" not in re.search(r"ReadSchema: (.*)", text).group(1)


HOT_KEY = "if(id % 10 < 9, 'hot', concat('s', id))"
REST = "id % 10 = 9"


def change_of_the_rest(ids):
    return ids.where(REST).selectExpr(
        "'p' project",
        f"{HOT_KEY} sha",
        "cast(null as string) previous_hash",
        "id tloc",
        "'x' log_author",
    )


def listings_of_a_hot_commit(ids):
    return ids.selectExpr(
        "'p' project",
        f"{HOT_KEY} sha",
        "cast(id as string) authorName",
        "cast(null as string) author",
        "array(named_struct('type', cast(id as string))) refactorings",
    )


def tloc_of_a_hot_commit(ids):
    return L.tloc_report(listings_of_a_hot_commit(ids), change_of_the_rest(ids))


def authors_of_a_hot_commit(ids):
    return E.effort_by_author(listings_of_a_hot_commit(ids), change_of_the_rest(ids))


def types_of_a_hot_commit(ids):
    return E.effort_by_type(listings_of_a_hot_commit(ids), change_of_the_rest(ids))


def log_authors_of_a_hot_commit(ids):
    log = change_of_the_rest(ids).withColumnRenamed("log_author", "author_name")
    return E.resolved_authors(listings_of_a_hot_commit(ids), log)


def children_of_a_hot_parent(ids):
    commits = ids.selectExpr(
        "'p' project", "cast(id as string) sha", f"array({HOT_KEY}) parents", "'x' author_name"
    )
    reports = ids.where(REST).selectExpr(
        "'p' project", f"{HOT_KEY} sha", "'ok' status", "'Go' language", "id n_lines"
    )
    return L.loc_delta(commits, L.snapshot_loc(reports))


def pages_of_a_hot_repository(ids):
    n_items = f"if({REST}, 1L, 100L) n_items"
    return I.mark_pages(
        ids.selectExpr("'o' owner", f"{HOT_KEY} repo", "id page", "200 status", n_items)
    )


def commits_of_a_hot_project(ids):
    names = ids.where(REST).selectExpr(f"{HOT_KEY} project")
    return M.listed_projects(ids.selectExpr(f"{HOT_KEY} project", "id"), names)


def commits_of_a_hot_unfinished_project(ids):
    names = ids.where(REST).selectExpr(f"{HOT_KEY} project")
    return M.unprocessed_projects(ids.selectExpr(f"{HOT_KEY} project", "id"), names)


def authors_of_a_hot_project(ids):
    efforts = ids.selectExpr(f"{HOT_KEY} project", "cast(id as string) author", "id effort")
    return object_parts(efforts, "project", "author", "effort", "efforts")


@pytest.mark.parametrize(
    "query",
    [
        tloc_of_a_hot_commit,
        authors_of_a_hot_commit,
        types_of_a_hot_commit,
        log_authors_of_a_hot_commit,
        children_of_a_hot_parent,
        pages_of_a_hot_repository,
        commits_of_a_hot_project,
        commits_of_a_hot_unfinished_project,
        authors_of_a_hot_project,
    ],
)
def test_a_hot_key_does_not_stay_in_one_task(spark, query):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        # Small map stages would be coalesced into one task, and a task is not split.
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = query(spark.range(100_000))
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "skew=true" in text


def test_finished_projects_are_not_read_again(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.range(200).selectExpr("concat('p', id % 20) project", "cast(id as string) sha")
    rows.write.partitionBy("project").parquet(path)
    changes = spark.read.schema("sha string, project string").parquet(path)
    names = rows.where("project <> ''").select("project").distinct()
    done = spark.createDataFrame([(f"p{i}",) for i in range(15)], "project string")
    todo = M.only_in(changes, M.not_in(names, done))
    assert todo.count() == 50
    assert "dynamicpruning" in todo._jdf.queryExecution().executedPlan().toString().lower()
