"""Readers, writers, ingest and whole jobs on files."""

import csv
import glob
import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from chronolode import schemas
from chronolode.operators import projects as P
from chronolode.operators import refactorings as R
from chronolode.plans import jobs
from chronolode.session import shared_dir
from chronolode.sources import readers, writers
from chronolode.streaming import ingest_chunks, landed_commits, landed_rejects


def put(root, path, text):
    full = os.path.join(str(root), path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def lines_of(path):
    out = []
    for name in sorted(glob.glob(f"{path}/**/part-*", recursive=True)):
        with open(name, encoding="utf-8", newline="") as f:
            out += f.read().splitlines()
    return out


def chunk(*shas):
    commits = [
        {"sha1": s, "url": "u", "authorName": "A", "refactorings": [{"type": "Move", "x": [1]}]}
        for s in shas
    ]
    return json.dumps({"commits": commits}, indent=2)


def put_chunks(root):
    put(root, "own_a b+c/chunk_1.json", chunk("s1", "s2"))
    put(root, "own_a b+c/chunk_2.json", '{"commits": []}')
    put(root, "own_a b+c/cut.json", chunk("s3")[:-40])
    put(root, "q/array.json", '[{"sha1": "s4"}, {"sha1": "s5"}]')
    put(root, "q/other.json", '{"counts": {}}')
    put(root, "q/table.csv", "refactoring_hash,TLOC\ns6,1\n")
    put(root, "q/mixed.json", '{"commits": [{"sha1": "s7", "author": {"name": "N"}}, {"sha1": "s8", "author": "T"}]}')


REJECTED = [("own_a b+c", "cut.json"), ("q", "array.json"), ("q", "other.json"), ("q", "table.csv")]


def base_names(df):
    return sorted((r.project, os.path.basename(r.file)) for r in df.collect())


def test_chunk_files_valid_and_rejected(spark, tmp_path, rows):
    put_chunks(tmp_path)
    ok, rejects = readers.read_chunks(spark, str(tmp_path))
    assert base_names(ok) == [
        ("own_a b+c", "chunk_1.json"),
        ("own_a b+c", "chunk_2.json"),
        ("q", "mixed.json"),
    ]
    assert base_names(rejects) == REJECTED
    listed = R.merge_chunks(ok)
    assert rows(listed, "project", "sha", F.to_json(F.struct("author")), "refactorings.type") == [
        ("own_a b+c", "s1", "{}", ["Move"]),
        ("own_a b+c", "s2", "{}", ["Move"]),
        ("q", "s7", '{"author":"{\\"name\\": \\"N\\"}"}', None),
        ("q", "s8", '{"author":"T"}', None),
    ]


def test_ingest_reads_each_file_once(spark, tmp_path, rows):
    source, target = (str(tmp_path / n) for n in ("in", "out"))
    put_chunks(source)

    def run():
        ingest_chunks(spark, source, target)
        return rows(landed_commits(spark, target), "sha")

    first = [("s1",), ("s2",), ("s7",), ("s8",)]
    assert run() == first
    assert base_names(landed_rejects(spark, target)) == REJECTED
    assert run() == first
    put(source, "q/chunk_9.json", chunk("s9", "s1"))
    put(source, "own_a b+c/chunk_9.json", chunk("s1"))
    assert run() == sorted([*first, ("s9",), ("s1",), ("s1",)])
    deduped = landed_commits(spark, target, dedup=True)
    assert rows(deduped, "project", "sha") == [
        ("own_a b+c", "s1"),
        ("own_a b+c", "s2"),
        ("q", "s1"),
        ("q", "s7"),
        ("q", "s8"),
        ("q", "s9"),
    ]


def test_paths_are_cut_without_a_pattern_over_the_whole_path(spark, rows):
    paths = ["file:/a/p0/x.json", "file:/a/project=p 1/.hidden", "s3://b/p/x.tar.gz", "/p/x", "/a//b", "/x.", "/p/a\nb.c"]
    df = spark.createDataFrame([(p,) for p in paths], "file string")
    path = F.col("file")
    found = df.select(
        "file",
        readers.folder(path) == F.regexp_extract(path, "([^/]+)/[^/]+$", 1),
        readers.stem(path) == F.regexp_extract(path, r"([^/]+?)(\.[^./]+)?$", 1),
    )
    assert [p for p, *same in found.collect() if not all(same)] == []
    # Tried for every record, a pattern without an anchor at its front took most of the ingest.
    assert "regexp_extract" not in df.select(readers.folder(path))._jdf.queryExecution().toString()


def test_a_replayed_batch_replaces_its_first_attempt(spark, tmp_path, rows):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    put(source, "p/chunk_1.json", chunk("s1"))
    ingest_chunks(spark, source, target, checkpoint)
    # Forget that the batch was committed, as if the driver had died just before.
    for name in glob.glob(f"{checkpoint}/commits/*") + glob.glob(f"{checkpoint}/commits/.*.crc"):
        os.remove(name)
    ingest_chunks(spark, source, target, checkpoint)
    assert rows(landed_commits(spark, target), "sha") == [("s1",)]


def test_measures(spark, tmp_path, rows):
    put(tmp_path, "m.csv", 'a;b,extra\n"1,own_é,""z""",x\n"2,ant,z",y\n3,w\n"4,ant,q",v\n')
    measures = readers.read_measures(spark, str(tmp_path / "m.csv"))
    assert rows(measures) == [('1,own_é,"z"', 0), ("2,ant,z", 1), ("3", 2), ("4,ant,q", 3)]
    assert rows(P.project_urls(measures), "project") == [("ant",), ("own_é",)]


def test_project_lists(spark, tmp_path):
    put(tmp_path, "o.json", json.dumps({"b": "u1", "a": "u2", "c": "u3"}, indent=4))
    put(tmp_path, "l.json", '["z", "y", "z"]')

    def names(path, **options):
        found = readers.read_projects(spark, str(tmp_path / path), **options)
        return [r.project for r in found.orderBy("doc", "i").collect()]

    assert names("o.json") == ["b", "a", "c"]
    assert names("l.json") == ["z", "y"]
    urls = spark.createDataFrame(
        [(f"n{i}", f"u{i}", i) for i in range(2500)], "project string, url string, pos bigint"
    )
    writers.write_urls(urls, str(tmp_path / "urls"))
    written = [json.loads(x) for x in lines_of(tmp_path / "urls")]
    assert written == [{"pos": i, "project": f"n{i}", "url": f"u{i}"} for i in range(2500)]
    put(tmp_path, "lines/a.json", '["b", "a"]\n{"c": "u"}\n["a", "d"]\n')
    assert names("lines", lines=True) == ["b", "a", "c", "d"]


def test_loc_reports_keep_empty_and_failed_apart(spark, tmp_path, rows):
    put(tmp_path, "p/full.json", '[{"Name": "Java", "Lines": 3, "Code": 1}, {"Name": "Go"}]')
    put(tmp_path, "p/none.json", "[]")
    put(tmp_path, "p/bad.json", '[{"Name": "Java", "Li')
    put(tmp_path, "p/blank.json", "\n")
    assert rows(readers.read_loc_reports(spark, str(tmp_path))) == sorted(
        [
            ("p", "full", "ok", "Java", 3),
            ("p", "full", "ok", "Go", None),
            ("p", "none", "ok", None, None),
            ("p", "bad", "tool_failed", None, None),
            ("p", "blank", "tool_failed", None, None),
        ],
        key=repr,
    )


def test_commit_log_json(spark, tmp_path, rows):
    record = {
        "project": "p",
        "sha": " s1\n",
        "pos": 0,
        "parents": [],
        "author_name": "Ann\t",
        "author_date": "2024-01-31T10:00:00+02:30",
        "committer_date": "2024-01-31 10:00:00 +0230",
        "message": "m",
        "on_head": True,
    }
    put(tmp_path, "log.json", "\n".join(json.dumps({**record, "sha": s}) for s in (" s1\n", "", " ")))
    log, rejects = readers.read_commits(spark, str(tmp_path), "json")
    got = rows(log, "sha", "author_name", "author_tz", F.unix_seconds("committer_ts"))
    assert got == [("s1", "Ann", "+02:30", 1706686200)]
    assert rejects.count() == 0
    put(tmp_path, "cut.json", '{"project": "p", "sha": "s2", "po\n{"project": "p", "sha": "s3", "pos": "x"}\n')
    log, rejects = readers.read_commits(spark, str(tmp_path), "json")
    assert rows(log, "sha") == [("s1",)]
    assert {(os.path.basename(r.file), r.record[-5:]) for r in rejects.collect()} == {
        ("cut.json", '", "po'[-5:]),
        ("cut.json", '"x"}'.rjust(5)),
    }


def test_issue_pages_keep_the_raw_text(spark, tmp_path, rows):
    put(tmp_path, "a.json", '{"owner":"o","repo":"r","page":1,"status":200,"issues":[{"id":1,"b":{"c":"é"}}]}\n')
    assert rows(readers.read_issue_pages(spark, str(tmp_path))[0], "issues") == [
        (['{"id":1,"b":{"c":"é"}}'],)
    ]


def test_tloc_file(spark, tmp_path):
    report = spark.createDataFrame(
        [("p", "s1", "N/A", 'He said "x", y ', 3)],
        "project string, refactoring_hash string, previous_hash string, author string, TLOC bigint",
    )
    writers.write_tloc(report, str(tmp_path / "t"))
    assert list(csv.reader(lines_of(tmp_path / "t" / "project=p"))) == [
        ["refactoring_hash", "previous_hash", "author", "TLOC"],
        ["s1", "N/A", 'He said "x", y ', "3"],
    ]


def test_effort_rows_of_a_large_project(spark, tmp_path, rows):
    authors = spark.range(3000).select(
        F.lit("p").alias("project"), F.concat(F.lit("a"), "id").alias("author"), F.col("id").alias("effort")
    )
    types = spark.createDataFrame([("p", "M", 4), ("q", "M", 1)], "project string, type string, effort bigint")
    writers.write_effort(authors, types, str(tmp_path / "e"))
    back = spark.read.schema("project string, map string, key string, effort bigint").json(str(tmp_path / "e"))
    want = [("p", "author", f"a{i}", i) for i in range(3000)] + [("p", "type", "M", 4), ("q", "type", "M", 1)]
    assert rows(back, "project", "map", "key", "effort") == sorted(want, key=repr)


def test_issues_keep_their_order_however_many_files(spark, tmp_path):
    issues = spark.range(40_000).select(
        F.lit("o").alias("owner"), F.lit("r").alias("repo"), (F.col("id") / 100).cast("long").alias("page"),
        (F.col("id") % 100).cast("int").alias("pos"), F.concat(F.lit('{"id":'), "id", F.lit("}")).alias("issue"),
    ).repartition(7)
    # As with large data, where the parts of a range are not joined to one file.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_issues(issues, str(tmp_path / "i"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(glob.glob(f"{tmp_path}/i/owner=o/repo=r/part-*")) > 1
    assert lines_of(tmp_path / "i") == [f'{{"id":{i}}}' for i in range(40_000)]


def test_long_diffs_are_read(spark, tmp_path):
    change = {"project": "p", "sha": "s", "pos": 0, "filename": "f", "change_type": "ADD"}
    put(tmp_path, "c.json", json.dumps({**change, "diff": "+x\n" * 8_000_000}) + '\n{"project": "q", "sh\n')
    changes, rejects = readers.read_file_changes(spark, str(tmp_path), "json")
    assert [tuple(r) for r in changes.select("sha", F.length("diff")).collect()] == [("s", 24_000_000)]
    assert [r.record for r in rejects.collect()] == ['{"project": "q", "sh']


def test_quoted_line_breaks_and_file_order(spark, tmp_path, rows):
    put(tmp_path, "m/b.csv", 'h\n"3,x\ny"\n')
    put(tmp_path, "m/a.csv", 'h\n"1,p"\n"2,q"\n' + '"9,zzz"\n' * 50)
    measures = readers.read_measures(spark, str(tmp_path / "m"))
    got = [r._c0 for r in measures.orderBy("pos").collect()]
    assert got == ["1,p", "2,q", *["9,zzz"] * 50, "3,x\ny"]
    assert [r.pos for r in measures.orderBy("pos").collect()] == list(range(53))


def test_a_silent_tool_has_failed(spark, tmp_path, rows):
    put(tmp_path, "p/a.json", '[{"Name": "Java", "Lines": 3}]')
    put(tmp_path, "p/empty.json", "")
    manifest = spark.createDataFrame([("p", "a"), ("p", "empty")], "project string, sha string")
    assert rows(readers.read_loc_reports(spark, str(tmp_path), manifest), "sha", "status", "n_lines") == [
        ("a", "ok", 3),
        ("empty", "tool_failed", None),
    ]


def test_repaired_and_late_chunks_are_ingested(spark, tmp_path, rows):
    source, target = (str(tmp_path / n) for n in ("in", "out"))
    put(source, "p/chunk_1.json", chunk("s1")[:-40])
    put(source, "p [x]/chunk_1.json", chunk("s2")[:-40])
    put(source, "p/none.json", '{"commi')
    ingest_chunks(spark, source, target)
    assert rows(landed_commits(spark, target), "sha") == []
    assert landed_rejects(spark, target).count() == 3
    put(source, "p/chunk_1.json", chunk("s1"))
    put(source, "p [x]/chunk_1.json", chunk("s2"))
    put(source, "p/none.json", '{"commits": []}')
    for name in glob.glob(f"{source}/*/*.json".replace("[", "[[]")):
        os.utime(name, (os.path.getmtime(name) + 5,) * 2)
    put(source, "q/old.json", chunk("s9"))
    os.utime(f"{source}/q/old.json", (1_600_000_000,) * 2)
    for _ in range(2):
        ingest_chunks(spark, source, target)
        assert rows(landed_commits(spark, target), "project", "sha") == [
            ("p [x]", "s2"), ("p", "s1"), ("q", "s9")]
        assert landed_rejects(spark, target).count() == 0


def test_rewriting_one_project_leaves_the_others(spark, tmp_path, rows):
    ddl = "project string, total bigint"
    path = str(tmp_path / "s")
    writers.write_refactoring_summary(spark.createDataFrame([("p", 1), ("q", 2)], ddl), path)
    writers.write_refactoring_summary(spark.createDataFrame([("q", 3)], ddl), path)
    assert rows(spark.read.schema(ddl).json(path), "project", "total") == [("p", 1), ("q", 3)]


def test_written_listings_read_back(spark, tmp_path, rows):
    listed = spark.createDataFrame(
        [("p", "s", "A", None, [("M",)]), ("q", "t", None, "x", None)], schemas.REFACTORING_COMMITS
    )
    for fmt in ("parquet", "json", "orc"):
        path = str(tmp_path / fmt)
        writers.write_refactoring_commits(listed, path, fmt)
        back, rejects = readers.read_refactoring_commits(spark, path, fmt)
        assert rejects.count() == 0
        assert rows(back, *listed.columns) == rows(listed)


def test_shared_folder_is_the_one_the_session_names(spark):
    def session(master, **conf):
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert shared_dir(session("yarn", **{"spark.checkpoint.dir": "hdfs:/c/"})) == "hdfs:/c"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("yarn"))
    assert os.path.isdir(shared_dir(spark))


@pytest.fixture
def facts(spark, tmp_path):
    chunks = str(tmp_path / "chunks")
    put(chunks, "p/chunk_1.json", chunk("s1", "s2"))
    put(chunks, "q/chunk_1.json", chunk("s1"))
    put(chunks, "unlisted/chunk_1.json", chunk("s1"))
    log = [
        ("p", "s0", 0, [], "Ann", "2024-01-01 00:00:00 +0000"),
        ("p", "s1", 1, ["s0"], "Ann", "2024-01-01 00:00:10 +0000"),
        ("p", "s2", 2, ["s1"], "Bob", "2024-01-01 01:00:20 +0100"),
        ("q", "s1", 0, [], "Eve", "2024-01-01 00:00:00 +0000"),
    ]
    put(
        tmp_path,
        "log/log.json",
        "\n".join(
            json.dumps(
                dict(
                    zip(["project", "sha", "pos", "parents", "author_name", "committer_date"], r),
                    author_date="2024-01-01T00:00:00Z",
                    message="m",
                    on_head=True,
                )
            )
            for r in log
        ),
    )
    for sha, n in (("s0", 5), ("s1", 9), ("s2", 2)):
        put(tmp_path, f"loc/p/{sha}.json", json.dumps([{"Name": "Java", "Lines": n}]))
    return chunks, readers.read_commits(spark, str(tmp_path / "log"), "json")[0]


def test_refactoring_and_effort_jobs(spark, tmp_path, facts, rows):
    chunks, commits = facts
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ckpt")
    projects = spark.createDataFrame([("p", 0), ("q", 1)], "project string, pos bigint")

    def run():
        jobs.refactoring_results(spark, chunks, commits, projects, out, checkpoint)
        ddl = "project string, counts map<string,bigint>, total bigint, avg_time bigint"
        summary = spark.read.schema(ddl).json(f"{out}/refactoring_summary")
        return rows(summary, "project", "counts", "total", "avg_time")

    want = [("p", {"Move": 2}, 2, 10), ("q", {"Move": 1}, 1, 0)]
    assert run() == want
    # A second run finds every project done.
    assert run() == want

    listed = landed_commits(spark, f"{out}/refactoring_commits")
    reports = readers.read_loc_reports(spark, str(tmp_path / "loc"))
    jobs.effort_results(commits, reports, listed.where("project = 'p'"), out)
    report = [x for x in lines_of(f"{out}/tloc/project=p") if not x.startswith("refactoring_hash")]
    assert report == ["s1,s0,Ann,4", "s2,s1,Bob,7"]
    effort = [json.loads(t) for t in lines_of(f"{out}/effort/project=p")]
    assert sorted((e["map"], e["key"], e["effort"]) for e in effort) == [("author", "A", 11), ("type", "Move", 11)]

    jobs.work_plan(commits, listed, out)
    plan = [json.loads(t) for t in lines_of(f"{out}/work_plan")]
    assert [(r["project"], r["start_commit"], r["members"]) for r in plan] == [("p", "s0", ["s0"])]


def test_diff_job_adds_only_new_projects(spark, tmp_path, facts):
    _, commits = facts
    out = str(tmp_path / "out")

    def run(*changes):
        jobs.diff_results(spark, commits, spark.createDataFrame(changes, schemas.FILE_CHANGES), out)
        heads = [json.loads(t) for t in lines_of(f"{out}/commit_diffs/commits/project=p")]
        files = spark.read.parquet(f"{out}/commit_diffs/files")
        return sorted(heads, key=lambda h: h["pos"]), sorted(
            (r.commit_hash, r.filename, r.diff_content, r.lines_added, r.lines_deleted) for r in files.collect()
        )

    a = ("p", "s1", 0, "a", "ADD", "+1")
    b = ("p", "s2", 0, "b", "MODIFY", "-1\n+é")
    nameless = ("p", "s2", 1, None, "MODIFY", "+1")
    first = run(a, b, nameless)
    assert [(h["commit_hash"], h["changed"], h["lines_deleted"]) for h in first[0]] == [("s1", 1, 0), ("s2", 1, 1)]
    assert first[1] == [("s1", "a", "+1", 1, 0), ("s2", "b", "-1\n+é", 1, 1)]
    rejected = [json.loads(t) for t in lines_of(f"{out}/rejected_changes")]
    assert [(r["sha"], r["pos"], r["reason"]) for r in rejected] == [("s2", 1, "nameless")]
    assert run(a) == first


DIFF_ROWS = [
    ("p", "s1", 0, "a", "ADD", "+1"),
    ("p", "s2", 0, "b", "MODIFY", "-1\n+é"),
    ("p", "s2", 1, None, "MODIFY", "+1"),
]


def _published(spark, out):
    heads, files = readers.read_commit_diffs(spark, f"{out}/commit_diffs")
    return (
        sorted((r.project, r.commit_hash, r.changed) for r in heads.collect()),
        sorted((r.project, r.commit_hash, r.filename) for r in files.collect()),
    )


@pytest.mark.parametrize("stop", ["write_diff_rejects", "write_commit_files", "write_commit_heads"])
def test_diff_job_stopped_after_any_write_then_rerun(spark, tmp_path, facts, monkeypatch, stop):
    """A stop after any of the three writes, then a rerun: exactly one copy of each row."""
    _, commits = facts
    out = str(tmp_path / "out")
    changes = spark.createDataFrame(DIFF_ROWS, schemas.FILE_CHANGES)
    done = f"{out}/commit_diffs/done"
    real = getattr(writers, stop)

    def write_then_stop(*args, **kwargs):
        real(*args, **kwargs)
        raise RuntimeError("driver lost")

    monkeypatch.setattr(writers, stop, write_then_stop)
    with pytest.raises(RuntimeError):
        jobs.diff_results(spark, commits, changes, out)
    assert readers.finished_projects(spark, done).count() == 0
    monkeypatch.undo()

    jobs.diff_results(spark, commits, changes, out)
    heads = [json.loads(t) for t in lines_of(f"{out}/commit_diffs/commits/project=p")]
    assert sorted((h["commit_hash"], h["changed"]) for h in heads) == [("s1", 1), ("s2", 1)]
    assert spark.read.parquet(f"{out}/commit_diffs/files").count() == 2
    rejected = [json.loads(t) for t in lines_of(f"{out}/rejected_changes")]
    assert [(r["sha"], r["pos"], r["reason"]) for r in rejected] == [("s2", 1, "nameless")]
    ledger = spark.read.parquet(done).collect()
    assert sorted(r.project for r in ledger) == ["p", "q"]
    assert _published(spark, out) == (
        [("p", "s1", 1), ("p", "s2", 1)],
        [("p", "s1", "a"), ("p", "s2", "b")],
    )
    # Finished projects, with or without changes, are not done again.
    jobs.diff_results(spark, commits, changes, out)
    assert spark.read.parquet(done).count() == 2
    assert spark.read.parquet(f"{out}/commit_diffs/files").count() == 2


def test_unfinished_projects_are_not_published(spark, tmp_path, facts, monkeypatch):
    _, commits = facts
    out = str(tmp_path / "out")
    changes = spark.createDataFrame(DIFF_ROWS, schemas.FILE_CHANGES)
    jobs.diff_results(spark, commits.where("project = 'q'"), changes, out)

    def stop(*args, **kwargs):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(writers, "publish_done", stop)
    with pytest.raises(RuntimeError):
        jobs.diff_results(spark, commits, changes, out)
    # Files and commits of p are written but not in the ledger: readers do not see them.
    assert os.path.exists(f"{out}/commit_diffs/commits/project=p")
    assert _published(spark, out) == ([], [])


def test_done_projects_are_read_off_the_folders(spark, tmp_path, rows):
    path = str(tmp_path / "s")
    assert rows(jobs._done_projects(spark, path)) == []
    names = ["007", "a b+c", "d:e%f", "é"]
    summary = spark.createDataFrame([(n, 1) for n in names], "project string, total bigint")
    writers.write_refactoring_summary(summary, path)
    done = jobs._done_projects(spark, path)
    assert rows(done) == [(n,) for n in names]
    assert "content" not in done._jdf.queryExecution().executedPlan().toString()


def test_url_and_issue_jobs(spark, tmp_path):
    out = str(tmp_path / "out")
    measures = spark.createDataFrame([("1,o_n,z", 0), ("2,a_b_c,z", 1)], "_c0 string, pos bigint")
    jobs.url_list(measures, out)
    urls = [json.loads(x) for x in lines_of(f"{out}/repos_urls")]
    assert urls == [{"pos": 0, "project": "o_n", "url": "https://github.com/o/n"}]
    assert [json.loads(t)["project"] for t in lines_of(f"{out}/rejected_names")] == ["a_b_c"]

    pages = spark.createDataFrame(
        [("o", "r", 1, 200, ['{"id":2}', '{"id":1}']), ("o", "x", 1, 200, ['{"id":9}'])],
        schemas.ISSUE_PAGES,
    )
    probe = spark.createDataFrame([("o", "r", 200, 2), ("o", "x", 404, 0)], schemas.ISSUE_PROBE)
    jobs.issue_results(pages, probe, out)
    assert lines_of(f"{out}/issues/owner=o/repo=r") == ['{"id":2}', '{"id":1}']
    assert not os.path.exists(f"{out}/issues/owner=o/repo=x")
    assert [json.loads(t) for t in lines_of(f"{out}/issue_counts")] == [
        {"owner": "o", "repo": "r", "n_issues": 2}
    ]
    assert [json.loads(t)["tracker"] for t in lines_of(f"{out}/untracked")] == ["none"]
