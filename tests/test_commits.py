import random

import pytest

from chronolode import schemas
from chronolode.operators import commits as C
from chronolode.operators import membership as M
from chronolode.operators.ordering import with_row_index

COMMITS = "project string, sha string, pos bigint, parents array<string>, on_head boolean"


def log(spark, n, project="p", on_head=True):
    return spark.createDataFrame(
        [(project, f"{project}{i:05d}", i, [f"{project}{i - 1:05d}"] if i else [], on_head) for i in range(1, n + 1)],
        COMMITS,
    )


def listed(spark, *shas):
    return spark.createDataFrame(
        [("p", s, None, None, []) for s in shas], schemas.REFACTORING_COMMITS
    )


def test_chunks_are_cut_after_removing_analysed_commits(spark, rows):
    done = C.analysed_commits(listed(spark, "p00005", "p00006", "p00005", "", None))
    assert done.count() == 2
    chunks = C.commit_chunks(C.pending_commits(log(spark, 250), done))
    bounds = C.chunk_bounds(chunks).orderBy("chunk").collect()
    assert [(b.chunk, b.n_commits, b.start_commit, b.end_commit) for b in bounds] == [
        (0, 100, "p00001", "p00102"),
        (1, 100, "p00103", "p00202"),
        (2, 48, "p00203", "p00250"),
    ]
    assert bounds[2].members == [f"p{i:05d}" for i in range(203, 251)]
    assert bounds[0].chunk_file == "chunk_p00001_p00102.json"


def test_a_chunk_of_one_commit_starts_and_ends_with_it(spark):
    none = C.analysed_commits(listed(spark))
    (b,) = C.chunk_bounds(C.commit_chunks(C.pending_commits(log(spark, 1), none))).collect()
    assert (b.start_commit, b.end_commit, b.members) == ("p00001", "p00001", ["p00001"])


def test_commits_off_the_head_are_not_pending(spark):
    both = log(spark, 3).union(log(spark, 4, "q", on_head=False))
    pending = C.pending_commits(both, C.analysed_commits(listed(spark, "p00002")))
    assert sorted(r.sha for r in pending.collect()) == ["p00001", "p00003"]


@pytest.mark.parametrize("bits", [0, 2, 16])
def test_row_index_numbers_each_group_in_order(spark, bits):
    rng = random.Random(bits)
    data = [("hot" if i % 3 else f"g{i % 7}", pos) for i, pos in enumerate(rng.sample(range(-500, 5000), 900))]
    df = spark.createDataFrame(data, "g string, pos bigint").repartition(5)
    got = with_row_index(df, ["g"], "pos", "idx", block_bits=bits).collect()
    want = {}
    for g in {g for g, _ in data}:
        for i, pos in enumerate(sorted(p for h, p in data if h == g)):
            want[g, pos] = i
    assert {(r.g, r.pos): r.idx for r in got} == want
    assert len(got) == len(data)


def test_row_index_breaks_ties(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 0)], "n string, pos bigint")
    got = with_row_index(df, [], "pos", "idx", ties=["n"]).orderBy("idx").collect()
    assert [r.n for r in got] == ["c", "a", "b"]


def test_first_parent_and_order(spark, rows):
    df = spark.createDataFrame(
        [("p", "m", 2, ["a", "b"], True), ("p", "a", 0, [], True), ("p", "b", 1, ["a"], True)],
        COMMITS,
    )
    assert rows(C.with_parent(df), "sha", "previous_hash") == [("b", "a"), ("m", "a")]
    assert [r.sha for r in C.oldest_first(df).collect()] == ["a", "b", "m"]
    assert [r.sha for r in C.newest_first(df).collect()] == ["m", "b", "a"]


def test_membership_keeps_duplicates(spark, rows):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "project string")
    names = spark.createDataFrame([("a",), ("a",), ("c",)], "project string")
    assert rows(M.listed_projects(df, names)) == [("a",), ("a",), ("c",)]
    assert rows(M.projects_with_results(df, names)) == [("a",), ("a",), ("c",)]
    assert rows(M.unprocessed_projects(df, names)) == [("b",)]
