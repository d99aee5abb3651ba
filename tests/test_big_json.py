"""Huge JSON documents read by byte ranges: the same elements as a whole-document parse."""

import json
import random

import pytest

from chronolode.sources import big_json


def _listing(n, seed):
    rng = random.Random(seed)
    tricky = ['{', '}', '[', ']', '\\"', '\\\\', '"', 'é', '\\u00e9', ' ', ',']
    commits = []
    for i in range(n):
        name = "".join(rng.choice(tricky + ["a", "b"]) for _ in range(rng.randrange(0, 12)))
        commits.append({
            "sha1": f"s{i}",
            "authorName": name,
            "author": None if i % 5 == 0 else f"a{i}",
            "refactorings": [{"type": rng.choice(["Move", "Extract {x}", "[y]"])} for _ in range(rng.randrange(0, 4))],
        })
    return commits


def _write(path, commits, extra=None):
    doc = {"commits": commits, **(extra or {})}
    text = json.dumps(doc, ensure_ascii=False, indent=rng_indent(len(commits)))
    path.write_text(text, encoding="utf-8")


def rng_indent(n):
    return None if n % 2 else 1


@pytest.mark.parametrize("split", [97, 1000, 1 << 20])
def test_elements_by_range_equal_a_whole_parse(spark, tmp_path, split):
    folder = tmp_path / "merged" / "proj"
    folder.mkdir(parents=True)
    commits = _listing(40, split)
    _write(folder / "a.json", commits, {"note": "[{ not an element }]", "more": [[1], {"x": 2}]})
    _write(folder / "b.json", commits[:3])
    (folder / "c.json").write_text('{"commits": []}')
    got, rejects = big_json.read_listing(spark, str(tmp_path / "merged"), split=split)
    rows = sorted(got.collect(), key=lambda r: (r.file, r.offset))
    found = [
        {"sha1": r.sha1, "authorName": r.authorName, "author": r.author,
         "refactorings": [{"type": x.type} for x in r.refactorings]}
        for r in rows if r.file.endswith("a.json")
    ]
    assert found == commits
    assert [r.sha1 for r in rows if r.file.endswith("b.json")] == ["s0", "s1", "s2"]
    assert {r.project for r in rows} == {"proj"}
    # Elements of the other arrays at the same depth are not commits: they are rejects.
    found = sorted(rejects.collect(), key=lambda r: (r.file, r.offset))
    assert [json.loads(r.element) for r in found] == [[1], {"x": 2}]
    if split < 1 << 20:
        assert big_json.read_elements(spark, str(folder / "a.json"), split=split).rdd.getNumPartitions() > 1


def test_a_document_larger_than_a_range_is_read_in_many_tasks(spark, tmp_path):
    path = tmp_path / "big.json"
    commits = _listing(3000, 1)
    _write(path, commits)
    size = path.stat().st_size
    raw = big_json.read_elements(spark, str(path), split=size // 20)
    assert raw.rdd.getNumPartitions() >= 20
    assert [json.loads(r.element) for r in raw.orderBy("offset").collect()] == commits


def test_cut_off_and_empty_documents(spark, tmp_path):
    (tmp_path / "cut.json").write_text('{"commits": [{"sha1": "s0"}, {"sha1": "s1", "au')
    (tmp_path / "empty.json").write_text("")
    raw = big_json.read_elements(spark, str(tmp_path), split=5)
    assert sorted(r.element for r in raw.collect()) == ['{"sha1": "s0"}', '{"sha1": "s1", "au']


def test_lexer_states_at_range_ends():
    assert big_json.summary(b'{"a": "x\\', False, False) == (True, True, 1)
    assert big_json.summary(b'"b"}', True, True) == (False, False, -1)
    assert big_json.summary(b'{[]}', True, False) == (True, False, 0)
