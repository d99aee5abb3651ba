import random
from statistics import mean

from pyspark.sql import functions as F

from chronolode import schemas
from chronolode.operators import refactorings as R


def listing(spark, rows):
    made = [
        (p, sha, None, None, None if types is None else [{"type": t} for t in types])
        for p, sha, types in rows
    ]
    return spark.createDataFrame(made, schemas.REFACTORING_COMMITS)


def log(spark, rows):
    df = spark.createDataFrame(rows, "project string, sha string, secs bigint")
    return df.select("project", "sha", F.timestamp_seconds("secs").alias("committer_ts"))


def test_counts_total_and_rejects(spark, rows):
    listed = listing(
        spark,
        [("p", "a", ["M", "M", "R"]), ("p", "b", None), ("p", "c", ["M", None]), ("q", "d", [])],
    )
    assert rows(R.refactoring_counts(listed)) == [("p", "M", 3), ("p", "R", 1)]
    assert rows(R.refactoring_total(listed)) == [("p", 4), ("q", 0)]
    assert rows(R.typeless_refactorings(listed)) == [("p", "c")]


def test_summary(spark):
    listed = listing(
        spark, [("p", "a", ["M", "R"]), ("p", "b", []), ("q", "c", None), ("r", "x", ["M"])]
    )
    commits = log(spark, [("p", "a", 0), ("p", "b", 7), ("q", "c", 5)])
    got = {r.project: r for r in R.refactoring_summary(listed, commits).collect()}
    assert (got["p"].counts, got["p"].total, got["p"].avg_time) == ({"M": 1, "R": 1}, 2, 7)
    assert (got["q"].counts, got["q"].total, got["q"].avg_time) == ({}, 0, 0)
    assert (got["r"].counts, got["r"].total, got["r"].avg_time) == ({"M": 1}, 1, 0)


def test_mean_gap_counts_every_listing_with_a_time(spark, rows):
    # Times 0, 0, 10: gaps 0 and 10. The hash without a log entry is dropped.
    listed = listing(spark, [("p", "a", []), ("p", "a", []), ("p", "b", ["M"]), ("p", "gone", [])])
    commits = log(spark, [("p", "a", 0), ("p", "b", 10)])
    assert rows(R.refactoring_gap(listed, commits)) == [("p", 5)]
    assert rows(R.listed_without_time(listed, commits), "sha") == [("gone",)]


def test_mean_gap_is_the_mean_of_sorted_gaps(spark):
    rng = random.Random(3)
    times = {f"p{i}": [rng.randrange(10**7) for _ in range(rng.randint(1, 9))] for i in range(60)}
    data = [(p, str(i), s) for p, ts in times.items() for i, s in enumerate(ts)]
    found = R.mean_gap_seconds(log(spark, data), "committer_ts", ["project"]).collect()
    for project, avg in found:
        ts = sorted(times[project])
        gaps = [b - a for a, b in zip(ts, ts[1:])]
        assert avg == (round(mean(gaps)) if gaps else 0)
    assert len(found) == len(times)


def test_merge_keeps_duplicates_unless_told(spark, rows):
    ddl = f"project string, file string, commits array<{schemas.LISTED_COMMIT}>"
    files = spark.createDataFrame(
        [
            ("p", "f1", [("a", "A", None, []), ("b", None, None, None)]),
            ("p", "f2", [("a", "B", None, [("M",)])]),
            ("p", "f3", []),
        ],
        ddl,
    )
    merged = R.merge_chunks(files)
    assert rows(merged, "sha", "authorName", "file", "pos") == sorted(
        [("a", "A", "f1", 0), ("b", None, "f1", 1), ("a", "B", "f2", 0)], key=repr
    )
    assert rows(R.merge_chunks(files, dedup=True), "sha", "authorName") == [("a", "A"), ("b", None)]
