"""Operators that judge rows one by one: words, quality, language, lengths, pages."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronolode.llm import extraction, language, quality, token_lengths
from chronolode.llm.arrays import Words
from chronolode.llm.common import table
from chronolode.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, row string, n long, hash string"


def docs_of(spark, texts, langs=None):
    """Rows with clashing extra columns; texts may be NULL, ids repeat at the end."""
    rows = [
        (i if i != 3 else None, t, langs[i] if langs else None, "s", "x", 1, "h")
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aA bé\n\t😀#Z\x0b\x85", max_size=30), max_size=8))
def test_words_are_those_of_the_expression(texts):
    words = Words(pa.array(texts, pa.string()), lower=True)
    found = [
        (int(r), words.data[a:b].tobytes().decode())
        for r, a, b in zip(words.row, words.start, words.end)
    ]
    want = [(i, m[0]) for i, t in enumerate(texts) for m in WORD.finditer(t)]
    assert found == want
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for _, w in want]
    same = {}
    for h, w in zip(words.hash.tolist(), lower):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)
    start, end, row = words.lines()
    lines = [(int(r), words.data[a:b].tobytes().decode()) for a, b, r in zip(start, end, row)]
    assert lines == [(i, x) for i, t in enumerate(texts) for x in t.split("\n")]


def base_measures(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 5))
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, dup, len(covered)


def test_quality_base_rules_match_brute_force_on_odd_texts(spark):
    texts = ["", None, " \n\t", "a\nb\na\n\n", "x " * 3000, "é# ñ$ " * 7 + "end", "same", "same",
             "one two three four five six\n" * 3, "A a A a A a A a A a A a", "w" * 200_000]
    rows = quality.judge(docs_of(spark, texts), None).collect()
    assert len(rows) == len(texts)
    found = sorted(
        (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows
    )
    assert found == sorted(map(base_measures, texts))
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed)


def test_quality_learns_the_labels_and_survives_their_absence(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = QUERIES["op1_quality_rules"](spark, SF).collect()
    judged = [(r.kept, known[r.doc_id]) for r in rows if r.doc_id in known and not r.base_failed]
    assert len(rows) == docs.count()
    assert np.mean([k == bool(q) for k, q in judged]) > 0.95
    assert quality.fit(docs, labels.limit(0)) is None
    assert quality.fit(docs.limit(0), labels) is None
    assert quality.fit(docs, labels.where("quality = 1")) is None


def test_language_of_held_out_rows_and_of_odd_rows(spark):
    rows = QUERIES["op5_language_id"](spark, SF).collect()
    lang = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    model = language.fit(table(spark, SF, "documents"))
    odd = language.predict(docs_of(spark, [None, "", "123 !?", "日本語", "the and of", "the and of"]), model)
    found = [(r.lang_pred, r.score > 0) for r in odd.collect()]
    assert [f[0] for f in found[:3]] == ["und"] * 3
    assert found[4] == found[5] and found[4][0] == "en"


def test_large_alphabets_keep_all_orders():
    texts = ["the and of", "an other text", "".join(chr(0x4E00 + i) for i in range(400))]
    model = language._empty_model(["en", "zh"], texts)
    want = {t[i : i + n] for t in texts for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    assert model.landmarks.shape == (len(want), 3)
    presence, lettered = model.presences([*texts, "xyq", ""])
    for row, text in zip(presence, texts):
        assert row.sum() == len({text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)})
    # Letters of no landmark count as spaces.
    assert presence[3].sum() == 2 and presence[4].sum() == 0
    assert lettered.tolist() == [True, True, True, True, False]


def test_language_without_rows_to_learn_from(spark):
    nothing = docs_of(spark, ["a b", None])
    assert {r.lang_pred for r in language.identify(nothing).collect()} == {"und"}
    assert language.identify(nothing.limit(0)).count() == 0
    assert language.accepted(nothing).columns == nothing.columns


def test_lengths_and_their_histogram(spark):
    texts = ["", None, "one two", "one two", "a longer text, with 12 parts", "x" * 50_000, "ñandú 😀"]
    docs = docs_of(spark, texts)
    lengths = sorted(r.n_tokens for r in token_lengths.encoded_lengths(docs).collect())
    encode = token_lengths._encoding(f"{token_lengths.FOLDER}/{token_lengths.RANKS}").encode_ordinary
    assert lengths == sorted(len(encode(t or "")) for t in texts)
    histogram = token_lengths.length_histogram(token_lengths.encoded_lengths(docs))
    for r in histogram.collect():
        assert r.n_docs == lengths.count(r.n_tokens)
        assert r.docs_from == sum(n >= r.n_tokens for n in lengths)
        assert r.tokens_from == sum(n for n in lengths if n >= r.n_tokens)
        assert r.kept_at_limit == sum(min(n, r.n_tokens) for n in lengths)
        assert r.kept_at_limit + r.lost_at_limit == sum(lengths)
        assert r.share_within == pytest.approx(np.mean([n <= r.n_tokens for n in lengths]))
    limits = spark.createDataFrame([(0,), (3,), (10**9,)], "context long")
    for r in token_lengths.answers(histogram, limits).collect():
        assert r.kept_tokens == sum(min(n, r.context) for n in lengths)
        assert r.cut_docs == sum(n > r.context for n in lengths)
    empty = token_lengths.length_histogram(token_lengths.encoded_lengths(docs.limit(0)))
    assert empty.count() == 0


def test_minimum_cut_is_minimal():
    draw = random.Random(3)
    for _ in range(150):
        n = draw.randint(1, 7)
        gain = [draw.choice((-2.0, -1.0, -0.25, 0.25, 1.0, 3.0)) for _ in range(n)]
        edges = [(i, j, draw.choice((0.5, 1.5))) for i in range(n) for j in range(i) if draw.random() < 0.5]

        def cost(labels, gain=gain, edges=edges):
            lost = sum(abs(g) for g, x in zip(gain, labels) if (g > 0) != x)
            return lost + sum(w for i, j, w in edges if labels[i] != labels[j])

        best = min(cost(x) for x in itertools.product((False, True), repeat=n))
        assert cost(extraction.minimum_cut(gain, edges)) == pytest.approx(best)


PAGE = """<html><head><title>T</title><style>p{}</style><script>if (a < b) x("</p>")</script></head><body>
<header class="site-header"><a href="/">Home</a> Slogan of the site.</header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies. <button>Accept</button></div>
<div id="content"><h1>A title</h1><p>First   paragraph of the text,
with a line break &amp; an entity.<p>Second <b>bold</b> paragraph goes on for some words.</p>
<div class="advert">Buy this now!</div><p>Short.</p><p>Third and last paragraph, again of several words.</p></div>
<aside>Related: <a href="/c">other text</a></aside><form><label>Mail</label><input name=a></form>
<section class="comments"><p>I read this, it is a long comment by a reader.</p></section>
<footer>&copy; Site</footer></body></html>"""


def test_main_text_of_a_page_without_an_article(spark):
    text = extraction.main_text(PAGE, extraction.fit(table(spark, SF, "pages")))
    assert text == (
        "A title\nFirst paragraph of the text, with a line break & an entity.\n"
        "Second bold paragraph goes on for some words.\nShort.\n"
        "Third and last paragraph, again of several words."
    )


def test_pages_of_the_table_and_odd_pages(spark):
    rows = QUERIES["op3_html_extraction"](spark, SF).collect()
    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    for r in rows:
        html = pages[r.page_id]
        article = html[html.index("<article>") : html.index("</article>")]
        want = " ".join(re.sub("<[^>]*>", " ", article).split())
        if "&" not in want:
            assert " ".join(r.text.split()) == want
        assert r.n_chars == len(r.text)
    odd = spark.createDataFrame(
        [(1, None, None, 5), (None, "u", "", 5), (2, "u", "<p>cut <a href='", 5), (2, "u", "no markup", 5),
         (3, "u", "<script>var x", 5), (4, "u", "<div>" * 3000 + "deep", 5)],
        "page_id long, url string, html string, text int",
    )
    found = extraction.extract(odd).collect()
    assert len(found) == 6
    assert [r.n_chars for r in found if r.page_id in (1, 3, None)] == [0, 0, 0]
    assert extraction.extract(odd.limit(0)).count() == 0
