"""LOC change rules, report and effort on hand-made rows."""

import pytest

from chronolode import schemas
from chronolode.operators import effort, loc

LISTED = schemas.REFACTORING_COMMITS


@pytest.fixture(scope="module")
def commits(spark):
    rows = [
        ("p", "root", 0, [], "Ann"),
        ("p", "c1", 1, ["root"], "Ann"),
        ("p", "c2", 2, ["c1", "root"], ""),
        ("p", "broken", 3, ["c2"], "Bob"),
        ("p", "after", 4, ["broken"], "Bob"),
        ("p", "tool", 5, ["c2"], "Cid"),
        ("p", "absent", 6, ["c2"], "Cid"),
        ("p", "unparented", 7, ["gone"], "Dee"),
        ("q", "c1", 0, ["root"], "Eve"),
    ]
    return spark.createDataFrame(
        rows, "project string, sha string, pos bigint, parents array<string>, author_name string"
    )


@pytest.fixture(scope="module")
def reports(spark):
    rows = [
        ("p", "root", "ok", "Java", 10),
        ("p", "root", "ok", "Markdown", 500),
        ("p", "c1", "ok", "Java", 4),
        ("p", "c1", "ok", "C++", 3),
        ("p", "c1", "ok", "Python", None),
        ("p", "c2", "ok", None, None),
        ("p", "broken", "checkout_failed", None, None),
        ("p", "after", "ok", "Go", 9),
        ("p", "tool", "tool_failed", None, None),
        ("p", "unparented", "ok", "Go", 9),
        ("q", "c1", "ok", "Go", 1),
    ]
    return spark.createDataFrame(rows, schemas.LOC_REPORTS)


@pytest.fixture(scope="module")
def delta(commits, reports):
    return loc.loc_delta(commits, loc.snapshot_loc(reports))


def listing(spark, *rows):
    made = []
    for sha, types in rows:
        refs = None if types is None else [{"type": t} for t in types]
        made.append(("p", sha, None, None, refs))
    return spark.createDataFrame(made, LISTED)


def test_snapshot_totals(reports, rows):
    assert rows(loc.snapshot_loc(reports)) == sorted(
        [
            ("p", "root", "ok", 10),
            ("p", "c1", "ok", 7),
            ("p", "c2", "ok", 0),
            ("p", "broken", "checkout_failed", 0),
            ("p", "after", "ok", 9),
            ("p", "tool", "tool_failed", 0),
            ("p", "unparented", "ok", 9),
            ("q", "c1", "ok", 1),
        ],
        key=repr,
    )


def test_delta_rules(delta, rows):
    assert rows(delta) == sorted(
        [
            ("p", "root", None, 0, "Ann"),
            ("p", "c1", "root", 3, "Ann"),
            ("p", "c2", "c1", 7, ""),
            ("p", "broken", None, 0, "Bob"),
            ("p", "after", None, 0, "Bob"),
            ("p", "tool", "c2", 0, "Cid"),
            ("p", "absent", None, 0, "Cid"),
            ("p", "unparented", None, 0, "Dee"),
            # The same hash in another project is another commit.
            ("q", "c1", None, 0, "Eve"),
        ],
        key=repr,
    )


def test_report_has_a_row_per_listing(spark, delta, rows):
    listed = listing(
        spark, ("root", []), ("c1", []), ("c1", []), ("c2", []), ("nolog", []), ("", []), (None, [])
    )
    assert rows(loc.tloc_report(listed, delta)) == sorted(
        [
            ("p", "root", "N/A", "Unknown", 0),
            ("p", "c1", "root", "Ann", 3),
            ("p", "c1", "root", "Ann", 3),
            ("p", "c2", "c1", "Unknown", 7),
            ("p", "nolog", "N/A", "Unknown", 0),
        ],
        key=repr,
    )


def test_root_keeps_its_author_in_effort(spark, delta, rows):
    listed = listing(spark, ("root", []), ("c1", []), ("c1", []), ("c2", []), ("nolog", []))
    assert rows(effort.effort_by_author(listed, delta)) == [("p", "Ann", 6), ("p", "Unknown", 7)]


def test_stated_author_comes_first(spark, commits, delta, rows):
    listed = spark.createDataFrame(
        [
            ("p", "c1", "X", None, []),
            ("p", "c1", None, '{"name":"X"}', []),
            ("p", "c1", "", '{"mail":"m"}', []),
        ],
        LISTED,
    )
    assert rows(effort.effort_by_author(listed, delta)) == [("p", "Ann", 3), ("p", "X", 6)]
    assert rows(effort.resolved_authors(listed, commits), "author") == [("Ann",), ("X",), ("X",)]


def test_type_is_credited_once_per_refactoring(spark, delta, rows):
    listed = listing(
        spark, ("c1", ["Move", "Move", "Move", "Rename"]), ("c2", ["Move", None]), ("root", None)
    )
    assert rows(effort.effort_by_type(listed, delta)) == [("p", "Move", 16), ("p", "Rename", 3)]
