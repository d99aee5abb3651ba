"""Every stage of the pipeline against brute force on its own input."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from chronolode.llm import curriculum, decontamination, language
from chronolode.llm.arrays import Words
from chronolode.llm.common import stored, table

from test_corpus import SMALL, WORD, brute_components, brute_lines


def check_language_id(spark, before, after, docs):
    known = {r.doc_id: r for r in language.identify(docs).collect()}
    good = {i for i, r in known.items() if r.lang_pred != "und" and r.score >= 0.5}
    assert {r.doc_id for r in after} == good
    assert len(good) > 0.95 * len(before)


def check_line_dedup(spark, before, after, docs):
    gone = brute_lines([(r.doc_id, r.text) for r in before], 80)
    want = {
        r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if (r.doc_id, i) not in gone)
        for r in before
    }
    assert gone
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)


def check_ngram_jaccard_join(spark, before, after, docs):
    groups, _, _ = brute_components([(r.doc_id, r.text) for r in before], 75)
    assert sorted(r.doc_id for r in after) == sorted(i for i, _, c in groups if i == c)


def check_benchmark_decontamination(spark, before, after, docs):
    items = [r.text for r in table(spark, SMALL, "benchmark").collect()]
    words = lambda text: Words(pa.array([text], pa.string()), lower=True).hash
    items = [words(t) for t in items]
    leaks = set()
    for r in before:
        text = words(r.text)
        for item in items:
            if len(np.intersect1d(item, text)) * 2 >= len(np.unique(item)):
                score, _ = decontamination.alignment(item, text)
                if score >= decontamination.LEAST_SCORE * decontamination.MATCH * len(item):
                    leaks.add(r.doc_id)
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == leaks


def check_curriculum_mix(spark, before, after, docs):
    assert [r.position for r in after] == sorted(r.position for r in after)
    plan = {r.doc_id: r for r in curriculum.mixture(docs).collect()}
    size = {r.doc_id: len(WORD.findall(r.text)) for r in before}
    taken = {}
    for r in after:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + size[r.doc_id]
    assert taken == {i: r.taken for i, r in plan.items() if r.taken}


def test_stages(spark):
    corpus_pipeline.prepare(spark)
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SMALL), name)
        before, after = docs.collect(), out.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        else:
            after = stage(spark, docs, SMALL).collect()
        globals()[f"check_{name}"](spark, before, after, docs)
        docs = out
