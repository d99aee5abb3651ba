"""Spelling variant grouping: words one edit apart, found by pivotal bigrams, then led to a form.

Words: maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` of every text (NULL: none), A-Z lower-cased.
With ``h`` the unsigned crc32 of the UTF-8 text ``<doc_id>:<run>`` (a NULL id as the empty
text), a run whose ``h`` is divisible by 97 loses its code point ``h % length`` (from 0): typos
planted the same way in every run. Words are the distinct results of at least ``LEAST_LENGTH``
code points that occur at least ``LEAST_COUNT`` times (``n``) overall.

Two words are near when one inserted, deleted or replaced code point turns one into the other
(edit distance 1). A word's form is its near word of largest ``n`` (ties: the smaller word in
code-point order) if that ``n`` is at least twice its own; its root is where forms lead.

Candidates by the pivotal prefix filter for edit distance ``TAU`` = 1 and bigrams: bigrams
(with their positions) of each word are ordered by their count over all words, rarest first,
then by text; a word's prefix is its first ``Q * TAU + 1`` bigrams in that order (and any
further ones tied with the last); its pivots are ``TAU + 1`` prefix bigrams that do not overlap,
of least total count, chosen by dynamic programming. If two words are one edit apart, one edit
destroys at most one of the other's disjoint pivots, so a pivot of one survives in the other
at a position at most ``TAU`` away — and lies within the other's prefix when that prefix's last
bigram is not earlier in the order; one of the two words always qualifies. So joining every
word's pivots with every word's prefix bigrams on (bigram, position, length), at the five
(position, length) shifts one edit allows, finds every near pair; ``levenshtein`` verifies each candidate exactly. The join keys are the
bigram, the position and the length, so a common bigram is split by where it stands.

Two filters of fixed-size numbers come before it, as most words that share a bigram are far
apart: one edit changes the parity of at most two letters (``letters``), and leaves what stands
left of a surviving bigram or what stands right of it as it was (64-bit fingerprints).

Defined cases: NULL or empty texts and texts without letters give no run. Repeated documents
count as often as they occur. Ties in ``n`` go to the smaller word. Chains of forms end, as
``n`` at least doubles at each step. An empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolode.llm.common import LOWER, UPPER, stored, with_fields

# Fixed values of the contract.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
TYPO_EVERY = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
FORM_RATIO = 2
# Filter parameters: bigrams, one edit.
Q, TAU = 2, 1


def words(documents: DataFrame) -> DataFrame:
    """word, n: every word of at least LEAST_LENGTH code points that occurs LEAST_COUNT times."""
    runs = documents.select(
        F.col("doc_id"),
        F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), 0)).alias("run"),
    )
    # A typo only takes a code point away: shorter runs can never become words.
    low = runs.where(F.length("run") >= LEAST_LENGTH).select(
        "doc_id", F.translate("run", UPPER, LOWER).alias("low_")
    ).withColumn(
        "h",
        F.crc32(
            F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "low_").cast("binary")
        ),
    )
    word = F.when(
        F.col("h") % TYPO_EVERY == 0,
        F.expr("concat(substring(low_, 1, int(h % length(low_))), substring(low_, int(h % length(low_)) + 2))"),
    ).otherwise(F.col("low_"))
    return (
        low.select(word.alias("word"))
        .where(F.length("word") >= LEAST_LENGTH)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= LEAST_COUNT)
    )


def pivots_of(prefix: list[tuple[int, int, str]], k: int = TAU + 1, q: int = Q) -> list[tuple[int, str]]:
    """``k`` prefix bigrams (pos, count, gram) that do not overlap, of least total count.

    Dynamic programming over the bigrams in position order: ``best[t][i]`` is the cheapest
    choice of ``t`` bigrams whose last is bigram ``i``. Ties go to the earlier choice.
    """
    grams = sorted(prefix)
    m = len(grams)
    inf = float("inf")
    best = [[(inf, ())] * m for _ in range(k + 1)]
    for i in range(m):
        best[1][i] = (grams[i][1], (i,))
    for t in range(2, k + 1):
        for i in range(m):
            options = [
                (best[t - 1][j][0] + grams[i][1], best[t - 1][j][1] + (i,))
                for j in range(i)
                if grams[i][0] - grams[j][0] >= q and best[t - 1][j][0] < inf
            ]
            if options:
                best[t][i] = min(options)
    cost, chosen = min(best[k], default=(inf, ()))
    if cost == inf:
        # Fewer than k disjoint bigrams: every prefix bigram is a pivot (a superset is safe).
        chosen = tuple(range(m))
    return [(grams[i][0], grams[i][2]) for i in chosen]


def _pivots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for word, size, letters, prefix in zip(batch["word"], batch["size"], batch["letters"], batch["prefix"]):
            for pos, gram in pivots_of([(int(g["pos"]), int(g["count"]), g["gram"]) for g in prefix]):
                out.append((word, size, letters, gram, pos))
        yield pd.DataFrame(out, columns=["word", "size", "letters", "gram", "pos"])


def letters_of(words: list[str]) -> np.ndarray:
    """Bit by bit of 64, whether an odd number of a word's code points (modulo 64) fall on it."""
    at = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    out = np.zeros(len(words), np.uint64)
    np.bitwise_xor.at(out, row, np.uint64(1) << (at & np.uint64(63)))
    return out.view(np.int64)


def _letters(rows: DataFrame) -> DataFrame:
    """All columns, and the ``letters`` of the word."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = batch.column("word").to_pylist()
        return batch.append_column("letters", pa.array(letters_of(words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(step, batches)

    return rows.mapInArrow(run, with_fields(rows, rows.columns, "letters long"))


def _sides(rows: DataFrame) -> DataFrame:
    """All columns, and fingerprints of what stands left and right of the bigram in its word."""
    return rows.withColumn("left", F.expr("xxhash64(substring(word, 1, pos))")).withColumn(
        "right", F.expr(f"xxhash64(substring(word, pos + 1 + {Q}))")
    )


def _grams(vocabulary: DataFrame) -> DataFrame:
    """word, size, pos (from 0), gram: every bigram of every word."""
    return vocabulary.select(
        "word",
        F.length("word").alias("size"),
        F.explode(F.sequence(F.lit(0), F.length("word") - Q)).alias("pos"),
    ).withColumn("gram", F.expr(f"substring(word, pos + 1, {Q})"))


def candidates(vocabulary: DataFrame) -> DataFrame:
    """Word pairs (a < b, repeats possible) where a pivot of one lies in the prefix of the other,
    whose last prefix bigram is not earlier in the order."""
    grams = _grams(vocabulary)
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("count"))
    ranked = grams.join(counts, "gram").withColumn(
        "place",
        F.rank().over(Window.partitionBy("word").orderBy("count", "gram")),
    )
    prefix = stored(
        _letters(ranked.where(F.col("place") <= Q * TAU + 1).select("word", "size", "pos", "gram", "count")),
        "spelling-prefix",
    )
    # Order key of each word's last prefix bigram: the lemma needs a pivot of one word in the
    # prefix of a word whose last prefix bigram is not earlier.
    last = prefix.groupBy("word").agg(F.max(F.struct("count", "gram")).alias("last"))
    pivots = prefix.groupBy("word", "size", "letters").agg(
        F.collect_list(F.struct("pos", "count", "gram")).alias("prefix")
    ).mapInPandas(_pivots, "word string, size int, letters long, gram string, pos int")
    # Where a pivot of a can stand in b: one replaced code point keeps the length and the
    # position; one inserted (deleted) code point adds (takes) one to the length and moves what
    # follows it one place on (back). So (position, length) changes by (0, 0), (0, +1), (+1, +1),
    # (0, -1) or (-1, -1): five probes, not nine.
    shifts = [(0, 0), (0, 1), (1, 1), (0, -1), (-1, -1)]
    near = F.explode(
        F.array(
            *(
                F.struct((F.col("pos") + dp).alias("pos"), (F.col("size") + dl).alias("size"))
                for dp, dl in shifts
            )
        )
    )
    told = ["letters", "left", "right"]
    probes = (
        _sides(pivots)
        .join(last, "word")
        .select(
            F.col("word").alias("a"), F.col("last").alias("a_last"), "gram", near.alias("at"),
            *(F.col(c).alias(f"a_{c}") for c in told),
        )
        .select("a", "a_last", "gram", F.col("at.pos").alias("pos"), F.col("at.size").alias("size"),
                *(f"a_{c}" for c in told))
    )
    indexed = _sides(prefix).join(last, "word").select(
        F.col("word").alias("b"), F.col("last").alias("b_last"), "gram", "pos", "size",
        *(F.col(c).alias(f"b_{c}") for c in told),
    )
    found = probes.join(indexed, ["gram", "pos", "size"])
    return (
        found.where(
            (F.bit_count(F.col("a_letters").bitwiseXOR(F.col("b_letters"))) <= 2 * TAU)
            & ((F.col("a_left") == F.col("b_left")) | (F.col("a_right") == F.col("b_right")))
            & (F.col("a") != F.col("b"))
            & (F.col("b_last") >= F.col("a_last"))
        )
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )


def variants(documents: DataFrame) -> DataFrame:
    """word, form, root (strings), n, n_near, form_n (longs): see the module's docstring."""
    vocabulary = stored(words(documents), "spelling-words")
    # Verified before the pairs are made distinct: only near pairs reach the shuffle.
    pairs = candidates(vocabulary).where(F.levenshtein("a", "b", TAU) == 1).distinct()
    pairs = stored(pairs, "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"))
    )
    counted = both.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = counted.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct(F.negative("other_n").alias("minus_n"), F.col("other").alias("other"))).alias("top"),
    )
    forms = (
        vocabulary.join(best, "word", "left")
        .select(
            "word",
            F.col("n").cast("long").alias("n"),
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(-F.col("top.minus_n") >= FORM_RATIO * F.col("n"), F.col("top.other")).alias("form"),
        )
    )
    forms = stored(forms, "spelling-forms")
    return _rooted(forms)


def _rooted(forms: DataFrame) -> DataFrame:
    """Follow forms to their end by pointer doubling; one stored table per round."""
    step = forms.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        nxt = step.alias("s").join(step.alias("t"), F.col("s.root") == F.col("t.word")).select(
            F.col("s.word").alias("word"), F.col("t.root").alias("root"), (F.col("s.root") != F.col("t.root")).alias("moved")
        )
        nxt = stored(nxt, "spelling-roots")
        if nxt.where("moved").limit(1).count() == 0:
            break
        step = nxt.select("word", "root")
    form_n = forms.select(F.col("word").alias("form"), F.col("n").alias("form_n"))
    return (
        forms.join(nxt.select("word", "root"), "word")
        .join(form_n, "form", "left")
        .select("word", "form", "root", "n", "n_near", F.col("form_n").cast("long").alias("form_n"))
    )


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """The same rows by plain Python over (doc_id, text) pairs: for tests."""
    import re
    import zlib
    from collections import Counter

    counts: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % TYPO_EVERY == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1 :]
            counts[low] += 1
    vocab = {w: n for w, n in counts.items() if len(w) >= LEAST_LENGTH and n >= LEAST_COUNT}

    def one_edit(a: str, b: str) -> bool:
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        s, t = (a, b) if len(a) < len(b) else (b, a)
        return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))

    near = {w: [v for v in vocab if one_edit(w, v)] for w in vocab}
    form = {}
    for w, vs in near.items():
        top = min(vs, key=lambda v: (-vocab[v], v), default=None)
        form[w] = top if top is not None and vocab[top] >= FORM_RATIO * vocab[w] else None
    out = []
    for w in vocab:
        root = w
        while form[root] is not None:
            root = form[root]
        f = form[w]
        out.append((w, f, root, vocab[w], len(near[w]), vocab[f] if f else None))
    return out
