import json

from chronolode import schemas
from chronolode.operators import issues as I
from chronolode.operators import projects as P
from chronolode.sources.writers import url_objects

ROWS = ["1,own_x,z", "2,ant,z", "3", "4,ant,q", "5,,q", "6,a_b_c,q", "7,own_x,q", None]


def measures(spark, rows=ROWS):
    return spark.createDataFrame([(r, i) for i, r in enumerate(rows)], "_c0 string, pos bigint")


def test_urls_rejects_and_objects(spark, rows):
    urls = P.project_urls(measures(spark))
    assert rows(urls) == [
        ("ant", "https://github.com/apache/ant", 1),
        ("own_x", "https://github.com/own/x", 0),
    ]
    assert rows(P.project_name_rejects(measures(spark))) == [("a_b_c", 5)]
    (row,) = url_objects(urls).collect()
    assert list(json.loads(row.value)) == ["own_x", "ant"]


def test_url_objects_together_hold_every_project(spark):
    urls = P.project_urls(measures(spark, [f"{i},p{i},z" for i in range(50)]))
    parts = url_objects(urls, limit=16).orderBy("part").collect()
    assert [len(json.loads(r.value)) for r in parts] == [16, 16, 16, 2]
    assert sum((list(json.loads(r.value)) for r in parts), []) == [f"p{i}" for i in range(50)]


def test_slice_follows_list_order_and_honours_zero(spark):
    names = [f"n{i % 40:02d}" for i in range(100)]
    urls = P.project_urls(measures(spark, [f"{i},{n},z" for i, n in enumerate(names)]))

    def sliced(*args):
        return [r.project for r in P.project_slice(urls, *args).orderBy("idx").collect()]

    assert sliced(0, 3) == ["n00", "n01", "n02"]
    assert sliced(38, 7) == ["n38", "n39"]
    assert sliced(5, 0) == []
    assert len(sliced()) == 40


def pages(spark):
    made = []
    for repo, answers in {
        "r": [(200, 100), (200, 40), (200, 100)],
        "s": [(200, 100), (500, 0)],
        "t": [(200, 100), (200, 0)],
        "u": [(404, 0)],
        "v": [(200, 100), (200, 100)],
        "w": [(200, 100), (500, 100), (200, 100)],
        "x": [(200, None), (200, 100)],
    }.items():
        for page, (status, n) in enumerate(answers, 1):
            texts = None if n is None else [f'{{"id":{page * 1000 + i}}}' for i in range(n)]
            made.append(("o", repo, page, status, texts))
    return spark.createDataFrame(made, schemas.ISSUE_PAGES).repartition(3)


def test_pages_up_to_the_first_stop(spark, rows):
    kept = I.collect_pages(I.with_item_count(pages(spark)))
    assert rows(kept, "repo", "page") == [
        ("r", 1),
        ("r", 2),
        ("s", 1),
        ("t", 1),
        ("v", 1),
        ("v", 2),
        ("w", 1),
    ]


def test_issue_counts_and_texts(spark, rows):
    assert rows(I.issue_counts(pages(spark)), "repo", "n_issues") == [
        ("r", 140),
        ("s", 100),
        ("t", 100),
        ("u", 0),
        ("v", 200),
        ("w", 100),
        ("x", 0),
    ]
    texts = I.issues(pages(spark)).where("repo = 'r'").orderBy("page", "pos").collect()
    assert [json.loads(r.issue)["id"] for r in texts] == [*range(1000, 1100), *range(2000, 2040)]


def test_tracker(spark, rows):
    probe = spark.createDataFrame(
        [("o", "a", 404, 0), ("o", "b", 200, 3), ("o", "c", 200, 0), ("o", "d", 500, 0), ("o", "r", 200, 1)],
        schemas.ISSUE_PROBE,
    )
    assert rows(I.tracker_status(probe), "repo", "tracker") == [
        ("a", "none"),
        ("b", "github"),
        ("c", "error"),
        ("d", "error"),
        ("r", "github"),
    ]
    assert rows(I.tracked_pages(pages(spark), probe).select("repo").distinct()) == [("r",)]
