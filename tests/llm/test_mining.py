"""Hard negatives, URL rules and spelling variants against brute force, with edge cases."""

import random

import numpy as np
import pytest

from chronolode.llm import hard_negatives, spelling, url_rules
from chronolode.llm.common import table
from chronolode.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
EMB = "vec_id long, embedding array<float>, label int, key string, vec string"


def test_strassen_is_exact_on_odd_shapes():
    rng = np.random.default_rng(1)
    for m, k, n in [(1, 1, 1), (33, 65, 70), (100, 64, 129), (0, 5, 3)]:
        a = rng.integers(-300, 300, (m, k))
        b = rng.integers(-300, 300, (k, n))
        assert np.array_equal(hard_negatives.strassen(a, b), a @ b)


def test_large_components_are_summed_exactly():
    # The int64 bound is passed, so the tile is worked out in Python integers.
    big = [[6e6, 3.0], [5e6 + 0.3, -1.0]]
    got = hard_negatives.scores(big, big)
    want = [[sum(int(256 * x) * int(256 * y) for x, y in zip(u, v)) for v in big] for u in big]
    assert got.tolist() == want
    with pytest.raises(OverflowError):
        hard_negatives.scores([[1e15]], [[1e15]])


def _vectors(n, dim, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        vec = [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5, 0.125]) for _ in range(dim)]
        rows.append((i, vec, rng.randrange(3)))
    return rows


def test_hard_negatives_against_brute_force(spark):
    rows = _vectors(450, 6, 3)  # coarse values: many tied scores
    rows += [(700, None, 1), (701, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (702, [float("nan")] * 6, 2),
             (703, [0.5] * 6, None), (800, [0.25] * 3, 1), (900, [], 2), (100, rows[100][1], rows[100][2])]
    df = spark.createDataFrame([(i, v, l, "x", "y") for i, v, l in rows], EMB)
    got = sorted(tuple(r) for r in hard_negatives.mine(df).collect())
    want = sorted(hard_negatives.brute_force([(i, l, v) for i, v, l in rows]))
    assert got == want
    assert len(got) > 20


def test_hard_negatives_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_TILE", 2)
    monkeypatch.setattr(hard_negatives, "CANDIDATE_TILE", 40)
    monkeypatch.setattr(hard_negatives, "LEAF", 2)
    rows = _vectors(320, 5, 7)
    df = spark.createDataFrame([(i, v, l, "x", "y") for i, v, l in rows], EMB)
    got = sorted(tuple(r) for r in hard_negatives.mine(df).collect())
    assert got == sorted(hard_negatives.brute_force([(i, l, v) for i, v, l in rows]))


def test_hard_negatives_tiles_meet_in_every_partitioning(spark, monkeypatch):
    # Partitions that are not merged: both sides of a tile must hash alike.
    monkeypatch.setattr(hard_negatives, "ANCHOR_TILE", 2)
    monkeypatch.setattr(hard_negatives, "CANDIDATE_TILE", 40)
    rows = _vectors(320, 5, 7)
    df = spark.createDataFrame([(i, v, l, "x", "y") for i, v, l in rows], EMB)
    merge, parts = "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"
    before = spark.conf.get(merge), spark.conf.get(parts)
    spark.conf.set(merge, "false")
    spark.conf.set(parts, "23")
    try:
        got = sorted(tuple(r) for r in hard_negatives.mine(df).collect())
    finally:
        spark.conf.set(merge, before[0])
        spark.conf.set(parts, before[1])
    want = sorted(hard_negatives.brute_force([(i, l, v) for i, v, l in rows]))
    assert got == want and want


def test_hard_negatives_window_of_large_scores(spark):
    # Scores fit a long, 100 times a score does not.
    rng = random.Random(1)
    rows = [(i, [rng.randrange(1, 10) * 3e5 for _ in range(16)], rng.randrange(2)) for i in range(400)]
    df = spark.createDataFrame([(i, v, l, "x", "y") for i, v, l in rows], EMB)
    got = sorted(tuple(r) for r in hard_negatives.mine(df).collect())
    assert max(r[4] for r in got) > 2**63 // 100
    assert got == sorted(hard_negatives.brute_force([(i, l, v) for i, v, l in rows]))


def test_hard_negatives_without_ids_and_equal_floors(spark):
    rows = [(100, [0.5, 0.5], 1), (None, [0.5, 0.5], 1), (101, [0.5, 0.5], 1), (2**60 + 1, [0.5, 0.45], 2),
            (None, [0.5, 0.5], 2), (102, [0.5, 0.5], 2), (102, [0.5, 0.5 + 1 / 1024], 2)]
    df = spark.createDataFrame([(i, v, l, "x", "y") for i, v, l in rows], EMB)
    got = sorted((tuple(r) for r in hard_negatives.mine(df).collect()), key=lambda r: r[2])
    top = 2 * 128 * 128
    # 102 is one row: its two vectors have the same floors.
    assert got == [(100, 101, 1, 102, top, top), (100, 101, 2, None, top, top),
                   (100, 101, 3, 2**60 + 1, top, 128 * 128 + 128 * 115)]


def test_hard_negatives_empty_table(spark):
    df = spark.createDataFrame([], EMB)
    assert hard_negatives.mine(df).count() == 0


def test_hard_negatives_query_on_the_table(spark):
    emb = table(spark, SF, "embeddings")
    got = sorted(tuple(r) for r in QUERIES["op11_hard_negatives"](spark, SF).collect())
    want = sorted(
        hard_negatives.brute_force([(r.vec_id, r.label, r.embedding) for r in emb.collect()])
    )
    assert got == want


URLS = [
    "https://www.example.com/en/a", "http://example.com/en/", "https://EXAMPLE.com/EN/x",
    "https://a.b.example.com/en/x?y", "https://shop.com/", "https://shop.com", "https://xcom/",
    "http://site.net/es/1", "http://site.net/fr", "http://net/fr/x#y", "ftp://www.example.com/en",
    "no scheme/en/", None, "", "://com/x", "https://com/", "https://example.com.evil.org/en/",
    "https://a.www.example.com/en/deep", "https://example.com/de/", "https://hot.com/a",
]


def brute_url(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] + [len(rest)])
    host = rest[:end].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rest = rest[end:]
    end = min([i for i in (rest.find(c) for c in "?#") if i >= 0] + [len(rest)])
    path = rest[:end]
    fits = [
        (len(h) + len(p), v == "block", h + p, v)
        for h, p, v in url_rules.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if not fits:
        return host, path, None, url_rules.DEFAULT
    best = min(fits, key=lambda f: (-f[0], not f[1], f[2]))
    return host, path, best[2], best[3]


def test_url_rules_against_brute_force(spark, monkeypatch):
    # Small ranges: many ranges start inside an open rule; a hot host spreads over several.
    monkeypatch.setattr(url_rules, "RANGE_ROWS", 7)
    urls = URLS + ["https://hot.com/a"] * 40
    pages = spark.createDataFrame(
        [(i, u, "<p>", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, key string"
    )
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(urls)}


def test_url_rules_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(pages).count() == 0


def test_url_query_on_the_table(spark):
    pages = table(spark, SF, "pages").collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in QUERIES["op12_url_filters"](spark, SF).collect()}
    assert got == {r.page_id: brute_url(r.url) for r in pages}


def test_pivots_do_not_overlap_and_cost_least():
    prefix = [(0, 5, "ab"), (1, 1, "bc"), (2, 1, "cd"), (4, 9, "ef")]
    assert spelling.pivots_of(prefix) == [(0, "ab"), (2, "cd")]
    assert spelling.pivots_of([(3, 1, "aa"), (0, 2, "bb"), (1, 1, "cc")]) == [(1, "cc"), (3, "aa")]


def _spelling_docs(seed):
    rng = random.Random(seed)
    base = ["kitchen", "garden", "window", "station", "élan", "harbour", "pilgrim", "saucepan"]
    texts = []
    for _ in range(160):
        words = []
        for _ in range(rng.randrange(0, 12)):
            w = rng.choice(base)
            r = rng.random()
            if r < 0.1:
                at = rng.randrange(len(w))
                w = w[:at] + w[at + 1 :]
            elif r < 0.2:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice("aeiouÿ") + w[at + 1 :]
            elif r < 0.25:
                w = w.upper()
            words.append(w)
        texts.append(" ".join(words) + rng.choice(["", ", 123 ", "-x-"]))
    return texts + [None, "", "12345 !!", "Kitchen kitchen KITCHEN"]


def test_spelling_variants_against_brute_force(spark):
    texts = _spelling_docs(5)
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    docs = spark.createDataFrame(
        [(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int"
    )
    got = sorted(spelling.variants(docs).collect(), key=lambda r: r.word)
    want = sorted(spelling.brute_force(rows))
    assert [tuple(r) for r in got] == want
    assert any(r.form for r in got) and any(r.root != r.word for r in got)


def test_spelling_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(docs).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_spelling_query_on_the_table(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in QUERIES["op13_spelling_variants"](spark, sf).collect())
    assert got == sorted(spelling.brute_force([(r.doc_id, r.text) for r in docs]))


def test_spelling_candidates_are_few(spark):
    """Words of one rare bigram at the same place, far apart but for it, are no candidates."""
    rng = random.Random(8)

    def some(n):
        return "".join(rng.choice("abcde") for _ in range(n))

    rare = [some(4) + "zz" + some(4) for _ in range(60)]
    near = [(rare[0], rare[0][:-1]), (rare[1], "é" + rare[1]), (rare[2], rare[2][:9] + "z")]
    words = {*rare, *(some(10) for _ in range(500)), *(w for p in near for w in p)}
    vocabulary = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    found = {tuple(r) for r in spelling.candidates(vocabulary).collect()}
    assert {tuple(sorted(p)) for p in near} <= found
    assert sum("zz" in a and "zz" in b for a, b in found) < 100


def test_letters_tell_odd_counts():
    got = spelling.letters_of(["aab", "b", "", "ÿb"]).view(np.uint64).tolist()
    assert got == [1 << (98 & 63), 1 << (98 & 63), 0, 1 << (98 & 63) | 1 << (255 & 63)]
