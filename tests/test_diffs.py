import json

from pyspark.sql import functions as F

from chronolode import schemas
from chronolode.operators import diffs as D

CHANGES = [
    ("p", "c", 0, "a.java", "ADD", "+1"),
    ("p", "c", 1, "b.java", "DELETE", "-1\n-2"),
    ("p", "c", 2, "a.java", "MODIFY", "+1\n+2\n-3"),
    ("p", "d", 0, "bin", "RENAME", None),
    ("p", "root", 0, "a.java", "ADD", "+1"),
]
COMMITS = (
    "project string, sha string, pos bigint, parents array<string>, author_name string, "
    "author_date string, message string"
)


def changes(spark, rows=CHANGES):
    return spark.createDataFrame(rows, schemas.FILE_CHANGES)


def commits(spark):
    return spark.createDataFrame(
        [
            ("p", "root", 0, [], "A", "2024-01-01T00:00:00+00:00", "m0"),
            ("p", "c", 1, ["root"], "A", "2024-01-02T00:00:00+02:00", "m1"),
            ("p", "d", 2, ["c", "root"], "B", "2024-01-03T00:00:00+00:00", "m2"),
            ("p", "empty", 3, ["d"], "B", "2024-01-04T00:00:00+00:00", "m3"),
        ],
        COMMITS,
    )


def test_totals_count_every_file(spark, rows):
    assert rows(D.commit_diff_stats(changes(spark))) == [
        ("p", "c", 1, 1, 3, 3, 3),
        ("p", "d", 0, 0, 0, 0, 1),
        ("p", "root", 1, 0, 1, 0, 1),
    ]


def test_last_change_wins_and_first_place_stays(spark, rows):
    columns = ["filename", "pos", "lines_added", "lines_deleted"]
    one = changes(spark).where("sha = 'c'")
    assert rows(D.file_diffs(one), *columns, "diff_content") == [
        ("a.java", 0, 2, 1, "+1\n+2\n-3"),
        ("b.java", 1, 0, 2, "-1\n-2"),
    ]
    assert rows(D.file_diffs(one, content=False), *columns) == [
        ("a.java", 0, 2, 1),
        ("b.java", 1, 0, 2),
    ]


def test_a_last_change_without_text_still_wins(spark):
    rows = [("p", "c", 0, "f", "MODIFY", "+1"), ("p", "c", 1, "f", "MODIFY", "")]
    (row,) = D.file_diffs(changes(spark, rows)).collect()
    assert (row.diff_content, row.lines_added) == (None, 0)


def records(spark, rows=CHANGES):
    named = D.named_changes(changes(spark, rows))
    heads = D.commit_heads(commits(spark), named)
    return heads, D.head_files(heads, named)


def test_heads_and_files(spark, rows):
    heads, files = records(spark)
    assert rows(heads) == [
        ("p", "c", 1, "root", "A", "2024-01-02T00:00:00+02:00", "m1", 1, 1, 3, 3, 3),
        ("p", "d", 2, "c", "B", "2024-01-03T00:00:00+00:00", "m2", 0, 0, 0, 0, 1),
    ]
    assert rows(files) == [
        ("p", "c", 0, "a.java", "+1\n+2\n-3", 2, 1),
        ("p", "c", 1, "b.java", "-1\n-2", 0, 2),
        ("p", "d", 0, "bin", None, 0, 0),
    ]


def test_nested_records(spark):
    got = {
        r.commit_hash: json.loads(r.s)
        for r in D.nested_records(*records(spark)).withColumn("s", F.to_json("diff_stats")).collect()
    }
    assert got["c"] == {
        "files_added": 1,
        "files_deleted": 1,
        "lines_added": 3,
        "lines_deleted": 3,
        "changed": 3,
        "file_diffs": {
            "a.java": {"diff_content": "+1\n+2\n-3", "lines_added": 2, "lines_deleted": 1},
            "b.java": {"diff_content": "-1\n-2", "lines_added": 0, "lines_deleted": 2},
        },
    }
    assert list(got["c"]["file_diffs"]) == ["a.java", "b.java"]
    assert got["d"]["file_diffs"] == {"bin": {"lines_added": 0, "lines_deleted": 0}}


def test_bad_changes_do_not_stop_the_others(spark, rows):
    spoilt = [*CHANGES, ("p", "c", 3, None, "ADD", "+1"), ("p", None, 0, "x", "ADD", "+1"),
              ("p", "c", 1, "c.java", "ADD", "+1"), ("p", "c", 9_000_000_000, "far", "ADD", "+1")]
    heads, files = records(spark, spoilt)
    assert rows(heads.where("commit_hash = 'c'"), "files_added", "changed") == [(3, 5)]
    assert [r[3] for r in rows(files.where("commit_hash = 'c'"))] == ["a.java", "b.java", "c.java", "far"]
    assert rows(D.file_change_rejects(changes(spark, spoilt))) == sorted(
        [("p", "c", 3, 1, "nameless"), ("p", None, 0, 1, "nameless"), ("p", "c", 1, 2, "repeated position")],
        key=repr,
    )


def test_a_huge_commit_has_the_shape_of_a_small_one(spark):
    many = [("p", "c", i, f"f{i % 1500}", "MODIFY", "+x\n" * (i % 7 + 1)) for i in range(3000)]
    heads, files = records(spark, many)
    assert [r.changed for r in heads.collect()] == [3000]
    got = {r.filename: (r.file_pos, r.lines_added) for r in files.collect()}
    assert got == {f"f{i}": (i, (i + 1500) % 7 + 1) for i in range(1500)}


def test_the_text_is_read_and_shuffled_once(spark, tmp_path):
    changes(spark).write.parquet(str(tmp_path / "c"))
    df = spark.read.schema(schemas.FILE_CHANGES).parquet(str(tmp_path / "c"))
    plan = D.named_changes(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange hash") == 1
