import random

import pytest
from pyspark.sql import functions as F

from chronolode import functions as fn

DIFFS = [
    ("@@ -1 +1 @@\n-a\r\n+b\n+++x\n---y\n--z\n+", (2, 2)),
    ("+a", (1, 0)),
    ("", (0, 0)),
    (None, (0, 0)),
    ("-\n-\n+\n\n", (1, 2)),
    ("\r+a\n+\r+\r+x", (1, 0)),
    ("a\r+b\n", (0, 0)),
    ("++a\n++\n--b", (2, 1)),
    ("a +b\u0085+c\x0b+d\n- -e", (0, 1)),
]


def by_lines(diff):
    added = deleted = 0
    for line in (diff or "").replace("\r", "").split("\n"):
        added += line[:1] == "+" and line[:3] != "+++"
        deleted += line[:1] == "-" and line[:3] != "---"
    return added, deleted


def counted(spark, diffs):
    df = spark.createDataFrame(list(enumerate(diffs)), "i int, diff string")
    diff = F.col("diff")
    found = df.select("i", fn.lines_added(diff), fn.lines_deleted(diff)).collect()
    return [tuple(r)[1:] for r in sorted(found)]


def test_diff_line_counts_of_the_edge_texts(spark):
    assert counted(spark, [d for d, _ in DIFFS]) == [want for _, want in DIFFS]


def test_diff_line_counts_of_random_texts(spark):
    rng = random.Random(7)
    diffs = ["".join(rng.choices("++--\r\n\na ", k=rng.randint(0, 60))) for _ in range(3000)]
    assert counted(spark, diffs) == [by_lines(d) for d in diffs]


def test_empty_diff_has_no_content(spark):
    df = spark.createDataFrame([("",), ("+a",), (None,)], "d string")
    assert [r[0] for r in df.select(fn.diff_content(F.col("d"))).collect()] == [None, "+a", None]


@pytest.mark.parametrize(
    ("name", "author", "log", "want"),
    [
        (None, '{"name":"N"}', None, "N"),
        (None, "Str", None, "Str"),
        ("", '{"x":1}', None, "Unknown"),
        ("A", None, "L", "A"),
        (None, None, None, "Unknown"),
        (None, '{"x":1}', "L", "L"),
        ("", '{"name":""}', "", "Unknown"),
    ],
)
def test_author_chain(spark, name, author, log, want):
    df = spark.createDataFrame([(name, author, log)], "n string, a string, l string")
    got = df.select(fn.resolve_author(F.col("n"), F.col("a"), F.col("l"))).first()[0]
    assert got == want


@pytest.mark.parametrize(
    ("micros", "parts", "want"),
    [
        (1_000_000, 2, 0),
        (3_000_000, 2, 2),
        (5_000_000, 2, 2),
        (172_801_000_000, 2, 86400),
        (7_000_000, 0, 0),
        (None, None, 0),
    ],
)
def test_half_even_mean(spark, micros, parts, want):
    df = spark.createDataFrame([(micros, parts)], "m bigint, p bigint")
    assert df.select(fn.half_even_seconds(F.col("m"), F.col("p"))).first()[0] == want


def test_times_keep_instant_and_offset(spark):
    df = spark.createDataFrame(
        [("2024-01-31 10:00:00 +0230", "2024-01-31T10:00:00+02:30"), ("bad", "bad")],
        "c string, a string",
    )
    got = df.select(
        F.unix_seconds(fn.parse_committer_time(F.col("c"))),
        F.unix_seconds(fn.parse_author_time(F.col("a"))),
        fn.offset_of(F.col("a")),
    ).collect()
    assert [tuple(r) for r in got] == [(1706686200, 1706686200, "+02:30"), (None, None, None)]


def test_names(spark):
    df = spark.createDataFrame(
        [("1,own_x,z",), ("2,ant,z",), ("3",), ("5,,q",), ("6,a_b_c,q",), ("7,b_,q",)], "r string"
    )
    name = fn.project_field(F.col("r"))
    got = df.select(name, fn.repo_url(name), fn.parse_owner_repo(name)["owner"]).collect()
    assert [tuple(r) for r in got] == [
        ("own_x", "https://github.com/own/x", "own"),
        ("ant", "https://github.com/apache/ant", None),
        (None, None, None),
        ("", "https://github.com/apache/", None),
        ("a_b_c", None, None),
        ("b_", "https://github.com/b/", "b"),
    ]


def test_fourteen_languages(spark):
    assert len(set(fn.PROGRAMMING_LANGUAGES)) == 14
    df = spark.createDataFrame([("C++",), ("Markdown",), ("java",)], "l string")
    got = df.select(fn.is_programming_language(F.col("l"))).collect()
    assert [r[0] for r in got] == [True, False, False]
