"""Benchmark decontamination: rare word and word-pair seeds, then Smith-Waterman alignment.

Words and word pairs of the benchmark items are counted in the corpus; each item keeps as
seeds so many of its rarest that no alignment of the wanted score can do without all of them
(``Items.keep``). Every passage of a document that shares a seed with an item is aligned with
the item word by word; the alignment score, as a share of what the whole item would score,
decides, so the result is that of aligning every item with every document. Words are compared
case-folded.

The benchmark is worked off in blocks of ``BLOCK_WORDS`` words at most (an item beyond that
is a block of its own), each of which is small enough to be sent to all tasks; the corpus is
read once per block for the counts and once for the alignments, and never shuffled.

Defined results: items and documents that are NULL or have fewer than ``LEAST_WORDS`` words
match nothing; an empty benchmark or corpus gives no row; equal items are reported each under
its id; a document that occurs twice is reported twice; extra columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronolode.llm.arrays import Words
from chronolode.llm.common import map_arrow, with_fields

LEAST_WORDS = 3
LEAST_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_WORDS = 1_000_000


def _folded(column: pa.Array) -> Words:
    """Words of a column after full case folding, which leaves white space alone."""

    def fold(text: bytes) -> bytes:
        if text.isascii():
            return text.lower()
        return text.decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape")

    return Words(pa.array([fold(t) for t in column.cast(pa.binary()).to_pylist()], pa.binary()))


class Items:
    """Words of a block of benchmark items and the seeds that point to them."""

    def __init__(self, rows: list[tuple[int, str]], least: float):
        self.ids = [i for i, _ in rows]
        words = _folded(pa.array([t for _, t in rows], pa.string()))
        self.words = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        # Smallest alignment score that reaches the threshold.
        self.least = [max(math.ceil(least * MATCH * len(w) - 1e-9), 1) for w in self.words]
        self.size, self.code, self.item, self.place = _grams(words)
        self.pairs = [np.zeros(0, np.uint64)] * len(rows)
        two = self.size == 2
        for k, code in zip(*_runs(self.item[two], self.code[two])):
            self.pairs[k] = code

    def keep(self, counts: dict[int, int]) -> Items:
        """Leave each item the seeds one of which every alignment of enough score holds.

        An alignment that matches m of n words in r runs scores at most ``2m - (r - 1)``; it
        leaves out n - m words and breaks ``n - 1 - (m - r)`` word pairs, which is at most
        ``n - least + m``. Of any s words one is matched unless m <= n - s, and of any
        ``2n - least - s + 1`` pairs one is whole if so. Each item takes the s that costs the
        fewest hits, and the rarest words and pairs. Those the corpus does not hold are among
        the lost ones of every alignment: they count, and are then dropped.
        """
        times = np.array([counts.get(int(c), 0) for c in self.code.view(np.int64)], np.int64)
        good = np.zeros(len(times), bool)
        for k, mine in zip(*_runs(self.item, np.arange(len(self.item)))):
            n, least = len(self.words[k]), self.least[k]
            if n < LEAST_WORDS:
                continue
            words, pairs = mine[self.size[mine] == 1], mine[self.size[mine] == 2]
            words = words[np.argsort(times[words], kind="stable")]
            pairs = pairs[np.argsort(times[pairs], kind="stable")]
            word_cost = np.append(0, np.cumsum(times[words]))
            pair_cost = np.append(0, np.cumsum(times[pairs]))
            # With this many words no pair is needed: a match of fewer scores too little.
            most = max(n - -(-least // MATCH) + 1, 0)
            costs = [(int(word_cost[most]), most, 0)]
            for s in range(most):
                p = 2 * n - least - s + 1
                if p <= len(pairs):
                    costs.append((int(word_cost[s] + pair_cost[p]), s, p))
            _, s, p = min(costs)
            good[words[:s]] = True
            good[pairs[:p]] = True
        good &= times > 0
        self.code, self.item, self.place = self.code[good], self.item[good], self.place[good]
        order = np.argsort(self.code, kind="stable")
        # All places of all seeds, ordered by code.
        self.code, self.item, self.place = self.code[order], self.item[order], self.place[order]
        return self

    def may_reach(self, k: int, words: np.ndarray, pairs: np.ndarray) -> bool:
        """Whether the words and pairs of a passage allow item k enough score (see ``keep``)."""
        both = np.isin(self.words[k], words).sum() + np.isin(self.pairs[k], pairs).sum()
        return both + 1 >= self.least[k]

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index into ``code``, index into the seeds) of equal n-grams."""
        low = np.searchsorted(self.code, code, "left")
        high = np.searchsorted(self.code, code, "right")
        hit = np.flatnonzero(high > low)
        n = high[hit] - low[hit]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(hit, n), np.repeat(low[hit], n) + inside


def _grams(words: Words) -> tuple[np.ndarray, ...]:
    """Size, code, row and place in the row of all words and word pairs."""
    grams = [words.ngrams(n) for n in (1, 2)]
    size = np.repeat([1, 2], [len(code) for code, _ in grams])
    code, at = (np.concatenate(x) for x in zip(*grams))
    row = words.row[at]
    return size, code, row, at - words.first[row]


def _runs(key: np.ndarray, value: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Keys that occur, and the values of each in their order."""
    order = np.argsort(key, kind="stable")
    names, first = np.unique(key[order], return_index=True)
    return names.tolist(), np.split(value[order], first[1:]) if len(names) else []


def alignment(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Best local alignment score, and the passage position after its last word.

    Rows are computed whole: a gap along the passage is a running maximum because its cost
    is linear.
    """
    n = len(passage)
    slide = -GAP * np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    best, end = 0, 0
    for word in item:
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + slide) - slide
        top = int(new.argmax())
        if new[top] > best:
            best, end = int(new[top]), top
        row = new
    return best, end


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in id order, streamed to the driver and handed on in blocks of bounded size."""
    rows, size = [], 0
    source = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    for r in source.orderBy("item_id", "text").toLocalIterator():
        words = r["text"].count(" ") + 1
        if rows and size + words > BLOCK_WORDS:
            yield rows
            rows, size = [], 0
        rows.append((r["item_id"], r["text"]))
        size += words
    if rows:
        yield rows


def _counts(docs: DataFrame, items: Items) -> dict[int, int]:
    """How often the block's n-grams occur in the corpus; at most one entry for each."""
    known = np.unique(items.code)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        code = _grams(_folded(batch.column("text")))[1]
        place = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
        code, times = np.unique(code[known[place] == code], return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(code.view(np.int64)), pa.array(times.astype(np.int64))], names=["code", "n"]
        )

    if not len(known):
        return {}
    found = map_arrow(docs.select("text"), step, "code long, n long")
    return {r["code"]: r["n"] for r in found.groupBy("code").agg(F.sum("n").alias("n")).collect()}


def _matches(batch: pa.RecordBatch, items: Items) -> list[tuple]:
    """(row, item id, score, first word, word after the last) of every item found in every row."""
    words = _folded(batch.column("text"))
    _, code, of, place = _grams(words)
    hit, seed = items.find(code)
    long = words.count()[of[hit]] >= LEAST_WORDS
    hit, seed = hit[long], seed[long]
    row, item = of[hit], items.item[seed]
    begin = words.first[row] + place[hit] - items.place[seed]  # where the item would begin
    order = np.lexsort((begin, item, row))
    row, item, begin = row[order], item[order], begin[order]
    pairs = np.zeros(len(words.hash), np.uint64)
    pair_code, pair_at = words.ngrams(2)
    pairs[pair_at] = pair_code
    out = []
    i = 0
    while i < len(row):
        r, k = int(row[i]), int(item[i])
        own, least = items.words[k], items.least[k]
        # An alignment of enough score has no more gaps than this.
        reach = max(MATCH * len(own) - least, 0)
        best, where = 0, (0, 0)
        # Seeds of nearby diagonals share one passage; all passages of the row are aligned.
        while i < len(row) and row[i] == r and item[i] == k:
            first = last = int(begin[i])
            while i < len(row) and row[i] == r and item[i] == k and begin[i] - last <= reach:
                last = int(begin[i])
                i += 1
            a = max(int(words.first[r]), first - reach)
            b = min(int(words.first[r + 1]), last + len(own) + reach)
            if not items.may_reach(k, words.hash[a:b], pairs[a : b - 1]):
                continue
            score, end = alignment(own, words.hash[a:b])
            if score > best:
                best, where = score, (a, a + end)
        if best >= least:
            # The same alignment backwards from its end tells where it begins.
            _, length = alignment(own[::-1], words.hash[where[0] : where[1]][::-1])
            end = where[1] - int(words.first[r])
            out.append((r, items.ids[k], best / (MATCH * len(own)), end - length, end))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """One row per document and item found in it: score and span in words."""
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    schema = with_fields(
        docs, ["doc_id"], f"item_id {item_type}, score double, from_word long, to_word long"
    )
    found = None
    for rows in _blocks(benchmark):
        items = Items(rows, least)
        items = items.keep(_counts(docs, items))

        def step(batch: pa.RecordBatch, items: Items = items) -> pa.RecordBatch:
            hits = _matches(batch, items)
            column = list(zip(*hits)) if hits else [()] * 5
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(column[0], pa.int64())),
                 pa.array(column[1], schema_types[1]), pa.array(column[2], pa.float64()),
                 pa.array(column[3], pa.int64()), pa.array(column[4], pa.int64())],
                names=schema.names,
            )

        schema_types = [None, {"bigint": pa.int64(), "int": pa.int32()}.get(item_type, pa.string())]
        part = map_arrow(docs.select("doc_id", "text"), step, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Rows that contain no benchmark item, with all their columns."""
    packed = docs.select("text", F.struct("*").alias("row"))
    schema = StructType([packed.schema["row"]])
    for rows in _blocks(benchmark):
        items = Items(rows, least)
        items = items.keep(_counts(docs, items))

        def step(batch: pa.RecordBatch, items: Items = items) -> pa.RecordBatch:
            good = np.ones(batch.num_rows, bool)
            good[[m[0] for m in _matches(batch, items)]] = False
            return pa.RecordBatch.from_arrays(
                [batch.column("row").filter(pa.array(good))], names=["row"]
            )

        packed = map_arrow(packed, step, schema).select(F.col("row.text").alias("text"), "row")
    return packed.select("row.*")
