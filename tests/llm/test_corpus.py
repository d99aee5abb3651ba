"""Operators that look at the whole corpus, against brute force on small fixtures."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolode.llm import curriculum, decontamination, jaccard, line_dedup, lm, pii, setjoin
from chronolode.llm.common import table
from chronolode.llm.queries import ORACLE, QUERIES, prepare
from checks.compare import canonical, duck

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, row string, node string, key string, label int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, rows):
    """(doc_id, text[, source]) rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame(
        [(r[0], r[1], r[2] if len(r) > 2 else "s", "row", "node", "key", 1) for r in rows], DOCS
    )


def near_copies(draw, words, edits):
    out = list(words)
    for _ in range(edits):
        out[draw.randrange(len(out))] = f"e{draw.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    """Families of near copies at all distances, exact copies, shared passages, odd rows."""
    draw = random.Random(5)
    rows, shared = [], " ".join(f"p{i}" for i in range(30))
    for family in range(6):
        words = [f"w{draw.randrange(4000)}" for _ in range(60)]
        for k in range(9):
            rows.append(near_copies(draw, words, (0, 1, 2, 3, 4, 5, 8, 0, 1)[k]))
    rows += [f"{shared} " + " ".join(f"u{draw.randrange(10**6)}" for _ in range(6)) for _ in range(14)]
    rows += ["", " \n", None, "one two", "One  TWO", "one two three four", "a b c d e", "A b\nc d e"]
    rows += ["long " * 20_000, rows[0]]
    draw.shuffle(rows)
    ids = draw.sample(range(1000), len(rows))
    ids[4], ids[5] = None, ids[6]
    return list(zip(ids, rows))


def shingles(text):
    words = WORD.findall(lower(text))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows, percent):
    """Smallest id reachable for each row; rows of one set are one node."""
    sets = [frozenset(shingles(t)) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[top(i)] = top(j)
    groups = defaultdict(list)
    for i, (name, _) in enumerate(rows):
        groups[top(i)].append(name)
    out = []
    for i, (name, _) in enumerate(rows):
        names = [n for n in groups[top(i)] if n is not None]
        out.append((name, len(sets[i]), min(names, default=None) if sets[i] else name))
    return out, [top(i) for i in range(len(rows))], sets


@pytest.mark.parametrize(("rounds", "held"), [(jaccard.ROUNDS, jaccard.LONG_RUN), (1, 8)])
def test_jaccard_components(spark, corpus, monkeypatch, rounds, held):
    """Also with one round, where the pair join does the rest, and regions too long to hold."""
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "LONG_RUN", held)
    want, _, _ = brute_components(corpus, 75)
    found = [tuple(r) for r in jaccard.components(frame(spark, corpus)).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_one_of_each_group_stays(spark, corpus):
    _, group, sets = brute_components(corpus, 75)
    df = frame(spark, corpus)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    want = len({g for g, s in zip(group, sets) if s}) + sum(not s for s in sets)
    assert len(rows) == want
    assert set(rows) <= set(corpus)
    assert jaccard.one_of_each(df.limit(0)).count() == 0
    assert jaccard.components(df.limit(0)).count() == 0


def test_images_never_differ_in_more_bits_than_their_sets(spark):
    """Sets of all sizes and overlaps; wide images are folded to narrow ones."""
    draw = np.random.default_rng(6)
    code = draw.integers(0, 2**64, 4000, dtype=np.uint64)
    one = [code[:n] for n in (1, 64, 65, 300, 3000, 3000, 70, 0, 900)]
    two = [code[k : k + n] for k, n in ((0, 1), (1, 64), (3, 60), (40, 300), (100, 3900), (3000, 900), (0, 64), (5, 9), (0, 900))]

    def image(sets):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        return jaccard.images_of(row, np.concatenate(sets), np.array([len(s) for s in sets])).to_pylist()

    rows = [(i, len(a), len(b), *x) for i, (a, b, *x) in enumerate(zip(one, two, image(one), image(two)))]
    df = spark.createDataFrame(rows, "i int, m int, n int, x array<long>, y array<long>")
    differ = jaccard.differing(F.col("x"), F.col("y"))
    most = jaccard.most_overlap(F.col("m"), F.col("n"), F.col("x"), F.col("y"))
    for i, bits, overlap in df.select("i", differ, most).collect():
        real = len(np.setxor1d(one[i], two[i]))
        assert bits <= real and overlap >= len(np.intersect1d(one[i], two[i]))
        # Images of 4,096 and 1,024 bits (or fewer) are not compared.
        assert bits >= real / 3 or i == 5


def test_texts_of_far_pairs_do_not_travel(spark, monkeypatch):
    """Documents that share one of their passages are told apart by their images."""
    draw = random.Random(9)
    passages = [" ".join(f"p{k}x{i}" for i in range(30)) for k in range(24)]
    rows = [(i, " ".join(draw.sample(passages, 6))) for i in range(40)]
    family = [f"w{draw.randrange(4000)}" for _ in range(200)]
    rows += [(100 + k, near_copies(draw, family, k % 3)) for k in range(6)]
    sent, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, texts: sent.append(pairs.count()) or verified(pairs, texts))
    want, _, _ = brute_components(rows, 75)
    assert sorted(tuple(r) for r in jaccard.components(frame(spark, rows)).collect()) == sorted(want)
    # Six copies of one family make at most 15 pairs; the others make none.
    assert 0 < sum(sent) <= 15


def test_labels_are_components(spark):
    draw = random.Random(1)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(900, 960)]
    found = {r.node: r.label for r in setjoin.labels_of(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def top(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        if a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    assert found == {i: top(i) for i in list(parent)}


def brute_lines(rows, percent):
    """(doc, line) of lines with an earlier match; a NULL id comes last."""
    lines = []
    for name, text in rows:
        for i, line in enumerate(text.split("\n") if text is not None else []):
            words = frozenset(WORD.findall(lower(line)))
            if len(words) >= line_dedup.LEAST_WORDS:
                lines.append((line_dedup.LAST if name is None else name, i, words))
    return {
        (d, i)
        for d, i, a in lines
        if any((e, j) < (d, i) and 100 * len(a & b) >= percent * len(a | b) for e, j, b in lines)
    }


@pytest.fixture(scope="module")
def line_rows():
    draw = random.Random(9)
    bases = [[f"w{draw.randrange(60)}" for _ in range(n)] for n in (5, 6, 8, 12, 20, 40) for _ in range(6)]
    rows = []
    for name in range(50):
        lines = [near_copies(draw, draw.choice(bases), draw.choice((0, 0, 1, 2, 3))) for _ in range(draw.randrange(5))]
        lines.insert(draw.randrange(len(lines) + 1), draw.choice(["", "short line", "ONE two"]))
        rows.append((name, "\n".join(lines)))
    rows += [(50, None), (None, rows[3][1]), (None, rows[3][1]), (7, rows[7][1]), (51, "\n\n"), (52, "z " * 50_000)]
    draw.shuffle(rows)
    return rows


def test_line_dedup(spark, line_rows):
    df = frame(spark, line_rows)
    gone = brute_lines(line_rows, line_dedup.PERCENT)
    assert {tuple(r) for r in line_dedup.removed_lines(df).collect()} == gone
    found = line_dedup.deduplicated(df)
    assert found.columns == df.columns
    want = []
    for name, text in line_rows:
        place = line_dedup.LAST if name is None else name
        kept = None if text is None else "\n".join(
            x for i, x in enumerate(text.split("\n")) if (place, i) not in gone
        )
        want.append((name, kept))
    assert Counter((r.doc_id, r.text) for r in found.collect()) == Counter(want)
    report = {r.doc_id: r.n_removed for r in line_dedup.line_report(df).collect()}
    assert sum(report[i] for i in range(53)) == sum(d < line_dedup.LAST for d, _ in gone)
    assert line_dedup.deduplicated(df.limit(0)).count() == 0


@pytest.mark.parametrize(("nearest", "held"), [(1, line_dedup.LONG_RUN), (1, 20)])
def test_lines_with_more_candidates_than_are_tried(spark, line_rows, monkeypatch, nearest, held):
    monkeypatch.setattr(line_dedup, "NEAREST", nearest)
    monkeypatch.setattr(line_dedup, "LONG_RUN", held)
    df = frame(spark, line_rows).repartition(5)
    gone = brute_lines(line_rows, line_dedup.PERCENT)
    assert {tuple(r) for r in line_dedup.removed_lines(df).collect()} == gone


@pytest.mark.parametrize("keys", [80, 3])
def test_pairs_of_a_run_are_those_that_pass(keys):
    draw = np.random.default_rng(keys)
    n, p = 300, 80
    rows = {
        "key": np.sort(draw.integers(0, keys, n)),
        "node": draw.integers(0, 200, n),
        "size": draw.integers(5, 40, n),
        "bits": draw.integers(0, 16, n),
    }
    rows["left"] = rows["size"] - draw.integers(0, 3, n)
    x, y, distance = line_dedup._pairs_in_runs(rows, p)
    for i in range(n):
        want = []
        for j in range(i):
            m, k = rows["size"][i], rows["size"][j]
            d = int(rows["bits"][i] ^ rows["bits"][j]).bit_count()
            if (
                rows["key"][i] == rows["key"][j] and rows["node"][i] != rows["node"][j]
                and 100 * min(m, k) >= p * max(m, k) and (100 + p) * d <= (100 - p) * (m + k)
                and min(rows["left"][i], rows["left"][j]) >= math.ceil(p * (m + k) / (100 + p))
            ):
                want.append(d)
        got = sorted(distance[x == i].tolist())
        tried = line_dedup.NEAREST + 1
        assert got[:tried] == sorted(want)[:tried]
        assert (len(got) > line_dedup.NEAREST) == (len(want) > line_dedup.NEAREST)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_agrees_with_its_sql(spark, name):
    want = duck(SMALL).sql(ORACLE[name]).to_arrow_table().to_pandas()
    found = QUERIES[name](spark, SMALL).toPandas()
    assert canonical(found).equals(canonical(want))


def test_alignment_is_smith_waterman():
    draw = random.Random(2)
    for _ in range(40):
        a = [draw.randrange(5) for _ in range(draw.randrange(1, 12))]
        b = [draw.randrange(5) for _ in range(draw.randrange(1, 15))]
        score = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                same = decontamination.MATCH if x == y else decontamination.MISMATCH
                score[i, j] = max(
                    0, score[i - 1, j - 1] + same,
                    score[i - 1, j] + decontamination.GAP, score[i, j - 1] + decontamination.GAP,
                )
        best, _ = decontamination.alignment(np.array(a, np.uint64), np.array(b, np.uint64))
        assert best == score.max()


def test_benchmark_copies_are_found_and_others_left(spark, monkeypatch):
    draw = random.Random(4)
    items = [(i, " ".join(f"b{draw.randrange(500)}" for _ in range(20 + i))) for i in range(12)]
    noise = lambda n: " ".join(f"w{draw.randrange(500)}" for _ in range(n))
    docs, want = [], set()
    for i, (k, text) in enumerate(items):
        words = text.split()
        edited = [w if j % 7 else "edited" for j, w in enumerate(words)]
        gapped = words[:8] + ["extra", "words"] + words[8:]
        docs += [(3 * i, f"{noise(30)} {text.upper()}\n{noise(9)}"), (3 * i + 1, " ".join(edited)),
                 (3 * i + 2, f"{noise(5)} {' '.join(gapped)}")]
        want |= {(3 * i + d, k) for d in range(3)}
    docs += [(100, noise(300)), (101, " ".join(items[0][1].split()[:4])), (102, None), (103, ""), (0, docs[0][1])]
    benchmark = spark.createDataFrame(
        [*items, (50, None), (51, ""), (52, "a b"), (53, items[2][1])], "item_id long, text string"
    )
    want |= {(d, 53) for d, k in want if k == 2}
    df = frame(spark, docs)
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, benchmark).collect()} == want
    kept = decontamination.clean(df, benchmark)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [100, 101, 102, 103]
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 60)
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, benchmark).collect()} == want
    assert sorted(r.doc_id for r in decontamination.clean(df, benchmark).collect()) == [100, 101, 102, 103]
    assert decontamination.contaminated(df, benchmark.limit(0)).count() == 0
    assert decontamination.clean(df, benchmark.limit(0)).count() == len(docs)
    assert decontamination.contaminated(df.limit(0), benchmark).count() == 0


def test_every_alignment_of_enough_score_is_found(spark):
    """Edits that break most runs of an item, and copies of a half, against brute force."""
    draw = random.Random(12)
    items = [(i, " ".join(f"b{draw.randrange(300)}" for _ in range((20, 38, 59, 3, 4, 7)[i % 6]))) for i in range(18)]
    noise = lambda n: [f"b{draw.randrange(300)}" for _ in range(n)]
    docs = []
    for i, (_, text) in enumerate(items):
        words, cut = text.split(), draw.randrange(1, 4)
        docs += [noise(9) + [w if j % 5 else "new" for j, w in enumerate(words)] + noise(9),
                 [w if j % 3 < 2 else "new" for j, w in enumerate(words)],
                 [x for w in words for x in (w, "new")], noise(5) + words[: len(words) // 2 + cut],
                 words[len(words) // 2 :] + noise(60) + words[: len(words) // 2],
                 [w for w in words if draw.random() < 0.8] + noise(2)]
        docs += [words] if i % 2 else []

    def score(a, b):
        row = [0] * (len(b) + 1)
        best = 0
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[-1] - 1))
            row, best = new, max(best, *new)
        return best / (2 * len(a))

    want = {}
    for d, words in enumerate(docs):
        for k, text in items:
            value = score(text.split(), words) if len(words) >= 3 else 0
            if value >= decontamination.LEAST_SCORE:
                want[d, k] = value
    df = frame(spark, [(d, " ".join(words)) for d, words in enumerate(docs)])
    found = decontamination.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.score for r in found} == pytest.approx(want)
    for r in found:
        assert score(items[r.item_id][1].split(), docs[r.doc_id][r.from_word : r.to_word]) == r.score


def test_benchmark_words_are_case_folded(spark):
    item = "ÉTÉ À LA PLAGE MIT GROSSEN STRASSEN ΟΔΟΣ"
    df = frame(spark, [(1, "été à la plage mit großen straßen οδος")])
    found = decontamination.contaminated(df, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert [(r.doc_id, r.item_id, r.score) for r in found.collect()] == [(1, 7, 1.0)]


EXPRESSIONS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, expression in EXPRESSIONS.items():
        for m in re.finditer(expression, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
                if not 16 <= len(digits) <= 19 or sum(d - 9 * (d > 9) for d in doubled) % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark):
    draw = random.Random(6)
    pieces = ["a.b@c.de", "x@y", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "300.1.1.1", "010.020.030.255", "😀ñ",
              "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+1 (234) 555-6789", "+12",
              "+1 ( 2", "12  34", "9" * 40, "word", "\n", "-", "a.b@c.de.", "@@", "+", "1.2.3"]
    texts = ["".join(draw.choice(pieces) + draw.choice(["", " ", " ", ", "]) for _ in range(draw.randrange(12)))
             for _ in range(300)]
    texts += [None, "", "7" * 60_000, "a" * 60_000 + "@", "1 2-" * 20_000, "a@b.c " * 300]
    rows = pii.find(frame(spark, list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(
            sum(s.startswith(k) for s in want) for k in EXPRESSIONS
        )
        assert set(want) <= set(r.spans.split(",")) | {""}
    assert pii.find(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_patterns_discover_unseen_identifiers(spark):
    draw = random.Random(8)
    number = lambda: f"+1 ({draw.randrange(100, 999)}) 555-{draw.randrange(1000, 9999)}"
    rows = [(i, f"w{draw.randrange(99)} please call {number()} today w{i}") for i in range(60)]
    rows += [(100, "so please call 555-123-4567 today again"), (101, "chapter 555-123-9999 follows"),
             (100, "so please call 555-123-4567 today again"), (None, "we please call 555.777.8888. today")]
    found = [(r.doc_id, r.spans) for r in pii.find(frame(spark, rows)).collect() if r.doc_id in (100, 101, None)]
    assert sorted(found, key=repr) == sorted(
        [(100, "phone:15:27"), (100, "phone:15:27"), (101, ""), (None, "phone:15:27")], key=repr
    )


def test_one_sided_context_and_repeats_do_not_hide_an_identifier(spark):
    draw = random.Random(18)
    number = lambda: f"+1 ({draw.randrange(100, 999)}) 555-{draw.randrange(1000, 9999)}"
    rows = [(i, f"v{i} call {number()} w{i}") for i in range(60)]
    rows += [(100, "so call 555-123-4567 w17"), (101, "chapter 555-123-9999 follows")]
    rows += [(200 + i, f"x{i} call 555-777-8888 y{i}") for i in range(30)]
    rows += [(300 + i, f"x{i} 555-777-8888 z{i}") for i in range(30)]
    found = {r.doc_id: r.spans for r in pii.find(frame(spark, rows)).collect()}
    assert (found[100], found[101]) == ("phone:8:20", "")
    for i in range(30):
        assert found[200 + i] == f"phone:{len(f'x{i} call ')}:{len(f'x{i} call ') + 12}"
        assert found[300 + i] == f"phone:{len(f'x{i} ')}:{len(f'x{i} ') + 12}"


def test_identifiers_with_spaces_are_discovered(spark):
    draw = random.Random(28)
    phone = lambda: f"+1 ({draw.randrange(100, 999)}) 555-{draw.randrange(1000, 9999)}"
    rows = [(i, f"v{i} call {phone()} w{i}") for i in range(60)]
    cards = [str(4 * 10**15 + draw.randrange(10**12)) for _ in range(900)]
    cards = [c for c in cards if f"card:0:{len(c)}" in base_spans(c)]
    rows += [(100 + i, f"v{i} card {c} w{i}") for i, c in enumerate(cards)]
    new = ["020 7946 0958", "0171 555 1234", "(401) 555-9421", "0171/555 1234", "2019 555-123-4567"]
    rows += [(1000 + i, f"so call {x} 5th w{i}") for i, x in enumerate(new)]
    rows += [(1010, "so call 12 34 w9"), (1011, "page 020 7946 0958x, 555 123 4567 w9"), (1012, "1  " * 2_000)]
    rows += [(1013, "my card 3782 822463 10005, w9"), (1014, "so call (020) 7946 0958. bye")]
    found = {r.doc_id: r.spans for r in pii.find(frame(spark, rows)).collect()}
    for i, x in enumerate(new):
        assert found[1000 + i] == f"phone:8:{8 + len(x)}"
    assert (found[1010], found[1011], found[1012]) == ("", "", "")
    assert (found[1013], found[1014]) == ("card:8:25", "phone:8:23")


def test_language_model(spark):
    draw = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(draw.choice(words[: draw.randrange(2, 41)]) for _ in range(draw.randrange(60))) for _ in range(150)]
    texts += [None, "", "unseen Words ONLY here", texts[0].upper(), "w1\nw2 " * 9000]
    rows = [*enumerate(texts), (None, "w1 w2"), (3, texts[3])]
    tokens = [[*WORD.findall(lower(t)), "<end>"] for _, t in rows]
    folds = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 for i, _ in rows]
    train = [t for t, f in zip(tokens, folds) if f]
    count = Counter(w for t in train for w in t)
    total, types = sum(count.values()), len(count)
    found = lm.score(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    want = sorted(
        (round(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (types + 1))) for w in t), 6), len(t),
         sum(count[w] > 0 for w in t), f == 0)
        for t, f in zip(tokens, folds)
    )
    got = sorted((round(r.base_score, 6), r.n_tokens, r.n_known, r.held_out) for r in found)
    assert [g[1:] for g in got] == [w[1:] for w in want]
    assert np.allclose([g[0] for g in got], [w[0] for w in want], atol=1e-5)
    assert {r.train_tokens for r in found} == {total}
    assert all(r.score < 0 for r in found)
    assert lm.score(frame(spark, rows).limit(0)).count() == 0


def test_a_block_meets_only_the_counts_it_needs(spark):
    docs = frame(spark, [(i, f"a b c {i}") for i in range(40)])
    answers = lm._answers(lm._packets(docs, 4))

    def names(rows, found):
        return pa.table({"names": [",".join(found.column_names)]})

    got = lm._with_answers(docs, answers, "train", names, "names string").distinct().collect()
    assert [r.names for r in got] == ["block,part,grams,train"]
    # Two blocks (one of the deleted fold) of a batch of texts that filled one block before.
    assert lm.BLOCK_BYTES <= 1 << 21


def test_model_scores_are_the_interpolated_probabilities(spark, monkeypatch):
    """With known weights, scores follow from counts; probabilities of a context sum to one."""
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice("abcdefg") for _ in range(25))) for i in range(80)]
    weights = np.tile([0.5, 0.3, 0.2], (lm.BUCKETS, 1))
    monkeypatch.setattr(lm, "expectation_maximisation", lambda cells, types: weights)
    count, pairs, contexts = Counter(), Counter(), Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            sequence = ["<s>", *t.split(), "<end>"]
            count.update(sequence[1:])
            for v, w in zip(sequence, sequence[1:]):
                pairs[v, w] += 1
                contexts[v] += 1
    total, types = sum(count.values()), len(count)
    for r in lm.score(frame(spark, rows)).collect():
        sequence = ["<s>", *dict(rows)[r.doc_id].split(), "<end>"]
        want = sum(
            math.log10(0.5 * pairs[v, w] / contexts[v] + 0.3 * count[w] / total + 0.2 / (types + 1))
            for v, w in zip(sequence, sequence[1:])
        )
        assert r.score == pytest.approx(want)


def test_expectation_maximisation_recovers_the_better_estimate():
    cells = [{"bucket": 3, "pair": -8, "word": -40, "n": 90}, {"bucket": 3, "pair": 1, "word": -24, "n": 10},
             {"bucket": 5, "pair": 1, "word": 1, "n": 7}]
    weights = lm.expectation_maximisation(cells, 1000)
    assert np.allclose(weights.sum(1), 1)
    assert weights[3, 0] > 0.8 and weights[5, 2] > 0.9 and weights[0, 0] == 0
    assert np.allclose(weights[4], weights[3]) or np.allclose(weights[4], weights[5])


def test_packed_numbers_come_back():
    draw = np.random.default_rng(1)
    keys = np.unique(draw.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2))
    assert (lm._unpack_sorted(lm._pack_sorted(keys)) == keys).all()
    small = draw.integers(0, 9, 70).astype(np.uint32)
    assert (lm._unplanes(lm._planes(small), np.uint32) == small).all()


def test_curriculum_of_odd_rows(spark):
    rows = [(1, "a b c", "x"), (2, "a " * 400, "y"), (3, None, None), (4, "b", None), (None, "c d", "x"),
            (None, "c d", "x"), (5, "", "z"), (6, "e f g h", "x"), (6, "e f", "y"), (7, "q", "w")]
    df = frame(spark, rows)
    plan = curriculum.mixture(df).collect()
    assert len(plan) == len(rows)
    sizes, weights = defaultdict(int), {}
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    for rank, source in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        weights[source] = (1, 2, 3)[rank % 3]
    targets, open_ = {}, set(sizes)
    while True:
        left = sum(sizes.values()) - sum(targets.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        targets |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    targets |= share
    for r in plan:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert r.taken == r["size"] * len(r.positions) <= 3 * r["size"]
        assert all(0 <= p <= 1 for p in r.positions) and sorted(r.positions) == list(r.positions)
    assert curriculum.mixture(df.limit(0)).count() == 0


def test_training_order_follows_the_schedules(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").withColumnRenamed("n_chars", "pass")
    plan = {r.doc_id: r for r in curriculum.mixture(docs).collect()}
    order = curriculum.training_order(docs).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    taken = Counter()
    for r in order:
        taken[r.doc_id] += plan[r.doc_id]["size"]
    assert taken == Counter({k: r.taken for k, r in plan.items() if r.taken})
    # In the first half, a source whose weight rises gives less than half of its words.
    half = Counter()
    for r in order:
        if r.position < 0.5:
            half[r.source] += plan[r.doc_id]["size"]
    for rank, source in enumerate(sorted(half)):
        slope = curriculum.SLOPES[rank % 3]
        whole = sum(r.taken for r in plan.values() if r.source == source)
        assert half[source] / whole == pytest.approx(0.5 - slope / 4, abs=0.12)


def test_mix_query_gives_rows_in_the_order_of_the_schedules(spark, monkeypatch):
    """The query's rows come as training first takes them, so its schedules show in its result."""
    mix = lambda: [tuple(r) for r in QUERIES["op9_curriculum_mix"](spark, "/root/testdata/sf0.01").collect()]
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    plan = curriculum.mixture(docs).collect()
    first = {r.doc_id: (not r.positions, *r.positions[:1], r.doc_id) for r in plan}
    rows = mix()
    assert [r[0] for r in rows] == sorted(first, key=first.get)
    assert {r[0]: r[4:] for r in rows} == {r.doc_id: (r.taken, len(r.positions)) for r in plan}
    monkeypatch.setattr(curriculum, "SLOPES", (0.5, 0.0, -0.5))
    other = mix()
    assert other != rows and sorted(other) == sorted(rows)


def test_bitmaps_tell_long_lines_apart():
    """Unrelated lines of 100 words pass a bitmap of 64 bits often, the wider one hardly ever."""
    draw = np.random.default_rng(3)
    text = pa.array([" ".join(f"w{i}" for i in draw.integers(0, 10**6, 100)) for _ in range(200)], pa.string())
    lines = line_dedup.Lines(text)
    bits = lines.bitmap().astype(np.uint64).reshape(200, -1)
    rows = {"size": lines.size, "left": lines.size, "node": lines.node.view(np.int64)}
    rows |= {name: bits[:, k].view(np.int64) for k, name in enumerate(("bits", "bits2")) if k < bits.shape[1]}
    x, y = np.triu_indices(200, 1)
    good, _ = line_dedup._passes({c: v[x] for c, v in rows.items()}, {c: v[y] for c, v in rows.items()}, 80)
    assert good.sum() < 5


def test_steps_leave_no_shuffle_files(spark):
    prepare(spark)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"


def test_nodes_that_are_needed_have_their_bit(spark):
    node = np.random.default_rng(4).integers(-(1 << 63), (1 << 63) - 1, 2000)
    bits = setjoin.may_hold(spark.createDataFrame([(int(n),) for n in node[:1000]], "node long"))
    assert setjoin.seen(node[:1000], bits).all()
    assert setjoin.seen(node[1000:], bits).sum() < 10


def test_texts_of_the_mix_are_shuffled_once_before_their_order(spark):
    """Window and join share a shuffle; the second one brings the rows into order."""
    df = frame(spark, [(i, "a b c " * (i % 5), None if i % 3 else "s") for i in range(40)])
    plan = curriculum.training_order(df)._jdf.queryExecution().executedPlan().toString()
    by_block = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "block" in x]
    assert by_block
    # A join by the source itself (NULL too) needs both in other keys, and the texts moved again.
    assert not any("coalesce(source" in x or "isnull(source" in x for x in by_block)
    assert sum("hashpartitioning(part" in x for x in by_block) <= 2, plan


@pytest.mark.parametrize(("most", "run"), [((1, 1), line_dedup.LONG_RUN), ((1, 2), 20), ((3, 8), line_dedup.LONG_RUN)])
def test_line_dedup_tries_the_rest_in_a_second_round(spark, line_rows, monkeypatch, most, run):
    monkeypatch.setattr(line_dedup, "NEAREST", 1)
    monkeypatch.setattr(line_dedup, "TRIED", 1)
    monkeypatch.setattr(line_dedup, "HELD", most)
    monkeypatch.setattr(line_dedup, "LONG_RUN", run)
    monkeypatch.setattr(line_dedup, "WIDE_FROM", 10)
    gone = brute_lines(line_rows, line_dedup.PERCENT)
    df = frame(spark, line_rows).repartition(5)
    assert {tuple(r) for r in line_dedup.removed_lines(df).collect()} == gone


def test_unrelated_long_lines_of_one_token_are_no_candidates(spark):
    """Their 128 bits are full, so all of them passed, and whole tokens met in the second round."""
    draw = np.random.default_rng(5)
    texts = ["all share this " + " ".join(f"w{i}" for i in draw.integers(0, 10**6, n)) for n in range(300, 360)]
    texts += [texts[7] + " more", texts[7]]
    df = frame(spark, list(enumerate(texts)))
    ranks = np.arange(1 << setjoin.COUNTER_BITS, dtype=np.uint64)
    # As if the shared words were the rarest.
    shared = line_dedup.Lines(pa.array(["all share this 1 2"])).code
    ranks[setjoin.counter_of(shared)] = 0
    found = line_dedup._candidates(line_dedup._tokens(df.withColumnRenamed("doc", "doc_id"), ranks, 80), 80).collect()
    assert len({(r.later, r.earlier) for r in found if r.earlier is not None}) < 5
    assert not [r for r in found if r.earlier is None]
    assert {tuple(r) for r in line_dedup.removed_lines(df).collect()} == {(60, 0), (61, 0)}


def test_copies_of_a_line_do_not_make_it_one_with_more_candidates(spark):
    base = " ".join(f"w{i}" for i in range(30))
    near = [f"{base} x{i}" for i in range(4)]
    # The first line comes again behind its near copies, in a task of its own.
    df = frame(spark, [(0, base), *enumerate(near, 1), (9, base)]).repartitionByRange(6, "doc_id")
    ranks = np.arange(1 << setjoin.COUNTER_BITS, dtype=np.uint64)
    node = line_dedup.Lines(pa.array([base])).node.view(np.int64)[0]
    found = line_dedup._candidates(line_dedup._tokens(df, ranks, 80), 80).collect()
    assert node not in {r.later for r in found}
    assert {r.doc for r in line_dedup.removed_lines(df).collect()} == {1, 2, 3, 4, 9}


def test_tokens_travel_packed(spark):
    """A row for each prefix token cost more disk than three times the input at 30 GB."""
    draw = np.random.default_rng(6)
    texts = [" ".join(f"w{i}" for i in draw.integers(0, 10**6, 40)) for _ in range(4000)]
    df = frame(spark, list(enumerate(texts))).coalesce(1)
    ranks = np.arange(1 << setjoin.COUNTER_BITS, dtype=np.uint64)
    rows = line_dedup._tokens(df, ranks, 80).collect()
    tokens = 4000 * 9
    assert len(rows) < tokens / 100
    assert sum(len(r.rows) for r in rows) < 40 * tokens


@pytest.mark.parametrize("run", [20, line_dedup.LONG_RUN])
def test_line_dedup_of_parts_that_are_not_held_whole(spark, line_rows, monkeypatch, run):
    monkeypatch.setattr(line_dedup, "PACKED_ROWS", (10, 1, 10))
    monkeypatch.setattr(line_dedup, "PART_ROWS", 30)
    monkeypatch.setattr(line_dedup, "LONG_RUN", run)
    gone = brute_lines(line_rows, line_dedup.PERCENT)
    df = frame(spark, line_rows).repartition(5)
    assert {tuple(r) for r in line_dedup.removed_lines(df).collect()} == gone
