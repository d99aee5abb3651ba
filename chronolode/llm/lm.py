"""Bigram language model by deleted interpolation; scores every text with it.

``P(w | v) = l2[b] * c(v w) / c(v) + l1[b] * c(w) / N + l0[b] / (V + 1)`` with weights that
depend on the bucket b of the context's frequency (powers of two). A tenth of the training
documents is set aside; expectation-maximisation learns the weights from its tokens under the
counts of the rest. Scores use the counts of all training documents.

How it runs at scale: a task cuts its rows into blocks of bounded text size and sends the
distinct n-grams of each block, sorted and packed, to the parts of the fingerprint range they
fall in. A part adds up all counts and answers each block with the counts of its n-grams, in
the same order. Blocks then meet their answers (one shuffle of the texts) and score locally.
No n-gram is dropped, no table of n-grams is ever whole in one place, and a frequent n-gram
is one number per block.

Both passes must cut the same blocks, so ``docs`` has to be a table that reads the same twice
(files do; put ``common.stored`` around anything else). A block whose answers do not fit is
an error, never a wrong score.

Defined results: NULL and empty texts are one end token; ids may be NULL or repeat, rows are
scored each on its own (a NULL id counts as the empty text for the folds); without training
rows all counts are 0 and scores are those of the uniform distribution; an empty table gives
no row; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronolode.llm.arrays import Words, mix
from chronolode.llm.common import fold, stored, text_steps, with_fields

FOLDS = 10
HELD_OUT, DELETED = 0, 1
# Text of one block; a task holds the tokens, n-grams and answers of one block at a time.
BLOCK_BYTES = 1 << 21
BUCKETS = 24
# Steps per octave in which EM sees probabilities.
STEPS = 8
EM_ROUNDS = 40
END = np.uint64(0x454E44)
START = np.uint64(0x5354415254)
_PACKET = "part int, block long, grams int, keys binary, base binary, deleted binary"
_ANSWER = "block long, part int, grams int, base binary, train binary, types long, tokens long"


def _planes(x: np.ndarray) -> bytes:
    """Bytes of whole numbers, low bytes first over all of them: small numbers compress."""
    width = x.dtype.itemsize
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T).tobytes()


def _unplanes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _pack_sorted(x: np.ndarray) -> bytes:
    return _planes(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(data, np.uint64), dtype=np.uint64)


class Tokens:
    """Token and bigram fingerprints of a batch of texts; each row ends with the end token."""

    def __init__(self, text: pa.Array):
        rows = len(text)
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        # A few texts at a time: the arrays over bytes are much larger than those over words.
        whole = pa.RecordBatch.from_arrays([text], names=["text"])
        for part in text_steps(whole, limit=1 << 20):
            words = Words(part.column("text"), lower=True)
            hashes.append(words.hash)
            counts.append(words.count())
        hashes, counts = np.concatenate(hashes), np.concatenate(counts)
        n = len(hashes)
        word_row = np.repeat(np.arange(rows), counts)
        first = np.cumsum(counts) - counts
        self.row = np.empty(n + rows, np.int64)
        self.token = np.empty(n + rows, np.uint64)
        ends = first + counts + np.arange(rows)
        at = np.arange(n) + word_row
        self.row[at], self.row[ends] = word_row, np.arange(rows)
        self.token[at], self.token[ends] = hashes, END
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[first + np.arange(rows)] = START
        self.pair = mix(self.context * np.uint64(0x9FB21C651E98DF25) + self.token)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of a task in blocks of about BLOCK_BYTES, numbered alike in every pass.

    Rows of the deleted fold have blocks of their own (odd numbers), which are the same if
    only that fold is read.
    """
    task = TaskContext.get().partitionId() << 32
    parts: list[list[pa.RecordBatch]] = [[], []]
    size, number = [0, 0], [0, 0]
    for batch in batches:
        deleted = batch.column("fold").to_numpy() == DELETED
        for kind, rows in enumerate((batch.filter(pa.array(~deleted)), batch.filter(pa.array(deleted)))):
            lengths = pa.compute.binary_length(rows.column("text")).to_numpy(zero_copy_only=False)
            start = 0
            for i, n in enumerate(lengths.tolist()):
                if size[kind] and size[kind] + n > BLOCK_BYTES:
                    if i > start:
                        parts[kind].append(rows.slice(start, i - start))
                    yield task | number[kind] << 1 | kind, pa.Table.from_batches(parts[kind])
                    parts[kind], size[kind], start = [], 0, i
                    number[kind] += 1
                size[kind] += n + 1
            if start < rows.num_rows:
                parts[kind].append(rows.slice(start))
    for kind in (0, 1):
        if parts[kind]:
            yield task | number[kind] << 1 | kind, pa.Table.from_batches(parts[kind])


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        fold(F.col("doc_id"), FOLDS).cast("int").alias("fold"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def _text(block: pa.Table) -> pa.Array:
    column = block.column("text").combine_chunks()
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _packets(docs: DataFrame, bits: int) -> DataFrame:
    """Distinct n-grams of every block with their counts, cut at the parts' bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = (np.arange(1, 1 << bits, dtype=np.uint64)) << np.uint64(64 - bits)
        for block, rows in _blocks(batches):
            tokens = Tokens(_text(rows))
            kind = rows.column("fold").to_numpy()[tokens.row]
            for grams, code in ((1, tokens.token), (2, tokens.pair)):
                code = mix(code) if grams == 1 else code
                keys, place = np.unique(code, return_inverse=True)
                base = np.bincount(place[kind > DELETED], minlength=len(keys)).astype(np.uint32)
                deleted = np.bincount(place[kind == DELETED], minlength=len(keys)).astype(np.uint32)
                cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
                full = [p for p in range(1 << bits) if cuts[p + 1] > cuts[p]]
                spans = [slice(cuts[p], cuts[p + 1]) for p in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()),
                     pa.array([grams] * len(full), pa.int32()),
                     pa.array([_pack_sorted(keys[s]) for s in spans], pa.binary()),
                     pa.array([_planes(base[s]) for s in spans], pa.binary()),
                     pa.array([_planes(deleted[s]) for s in spans], pa.binary())],
                    names=["part", "block", "grams", "keys", "base", "deleted"],
                )

    return _source(docs).mapInArrow(run, _PACKET)


def _answers(packets: DataFrame) -> DataFrame:
    """Counts of each packet's n-grams over all blocks; per part also types and tokens."""
    names = [f.name for f in StructType.fromDDL(_ANSWER).fields]

    def add_up(part: pa.Table) -> pa.Table:
        out = []
        for grams in (1, 2):
            rows = part.filter(pa.compute.equal(part.column("grams"), grams)).to_pylist()
            if not rows:
                continue
            keys = [_unpack_sorted(r["keys"]) for r in rows]
            all_keys, place = np.unique(np.concatenate(keys), return_inverse=True)
            sums = [
                np.bincount(
                    place, np.concatenate([_unplanes(r[c], np.uint32) for r in rows]), len(all_keys)
                ).astype(np.int64)
                for c in ("base", "deleted")
            ]
            base, train = sums[0], sums[0] + sums[1]
            end = np.cumsum([len(k) for k in keys])
            for r, k, b in zip(rows, keys, end):
                mine = place[b - len(k) : b]
                out.append(
                    (r["block"], r["part"], grams, _planes(base[mine]), _planes(train[mine]), None, None)
                )
            if grams == 1:
                # Two totals: of the training counts, and (part -1) of the base counts.
                out.append((-1, rows[0]["part"], 1, None, None, int((train > 0).sum()), int(train.sum())))
                out.append((-1, -1, 1, None, None, int((base > 0).sum()), int(base.sum())))
        columns = list(zip(*out))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return packets.groupBy("part").applyInArrow(add_up, _ANSWER)


@dataclass
class Model:
    train: tuple[int, int]  # types, tokens
    base: tuple[int, int]
    weights: np.ndarray | None = None  # buckets x (bigram, unigram, uniform)


class Counts:
    """Answers of one block put back in the order of its own sorted n-grams."""

    def __init__(self, tokens: Tokens, answers: pa.Table, which: str):
        rows = sorted(answers.select(["grams", "part", which]).to_pylist(), key=lambda r: (r["grams"], r["part"]))
        self.of = {}
        for grams, code in ((1, mix(tokens.token)), (2, tokens.pair)):
            keys = np.unique(code)
            found = [_unplanes(r[which], np.int64) for r in rows if r["grams"] == grams]
            count = np.concatenate(found) if found else np.zeros(0, np.int64)
            if len(count) != len(keys):
                raise ValueError("docs did not read the same twice; pass a stored table")
            self.of[grams] = (keys, count)
        self.word = self._get(1, mix(tokens.token))
        self.pair = self._get(2, tokens.pair)
        # A context is a word and as frequent as it, or the start: as frequent as the end.
        ends = self._get(1, mix(np.array([END])))[0]
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[tokens.context == START] = ends

    def _get(self, grams: int, code: np.ndarray) -> np.ndarray:
        keys, count = self.of[grams]
        return count[np.searchsorted(keys, code)]


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def _parts_of(counts: Counts, totals: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, float]:
    types, tokens = totals
    pair = counts.pair / np.maximum(counts.context, 1)
    return pair, counts.word / max(tokens, 1), 1.0 / (types + 1)


def _with_answers(
    docs: DataFrame, answers: DataFrame, which: str, step, schema, only_deleted: bool = False
) -> DataFrame:
    """Apply ``step(rows, answers)`` to every block, or to those of the deleted fold.

    Of the two counts of an answer only ``which`` travels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _blocks(batches):
            n = rows.num_rows
            rows = rows.append_column("block", pa.array(np.full(n, block), pa.int64()))
            rows = rows.append_column("place", pa.array(np.arange(n), pa.int64()))
            yield from rows.select(["block", "place", "doc_id", "fold", "text"]).to_batches()

    source, found = _source(docs), answers.where("block >= 0").select(
        "block", "part", "grams", which
    )
    if only_deleted:
        source = source.where(F.col("fold") == DELETED)
        found = found.where(F.col("block") % 2 == 1)
    fields = StructType(
        [*StructType.fromDDL("block long, place long").fields, source.schema["doc_id"],
         *StructType.fromDDL("fold int, text string").fields]
    )
    return (
        source.mapInArrow(run, fields)
        .groupBy("block")
        .cogroup(found.groupBy("block"))
        .applyInArrow(step, schema)
    )


def _held_out_cells(docs: DataFrame, answers: DataFrame, model: Model) -> list:
    """Tokens of the deleted part by bucket and rounded logs of both probabilities.

    The cells are a bounded grid, so their sums are small whatever the corpus.
    """
    base = model.base

    def cells(rows: pa.Table, found: pa.Table) -> pa.Table:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        names = ["bucket", "pair", "word", "n"]
        rows = rows.sort_by("place")
        if rows.num_rows == 0:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        tokens = Tokens(_text(rows))
        counts = Counts(tokens, found, "base")
        pair, word, _ = _parts_of(counts, base)
        code = np.stack([_bucket(counts.context), *(
            np.where(p > 0, np.round(STEPS * np.log2(np.where(p > 0, p, 1))), 1) for p in (pair, word)
        )]).astype(np.int32)
        code, n = np.unique(code, axis=1, return_counts=True)
        return pa.Table.from_arrays(
            [*(pa.array(c) for c in code), pa.array(n.astype(np.int64))], names=names
        )

    schema = "bucket int, pair int, word int, n long"
    found = _with_answers(docs, answers, "base", cells, schema, only_deleted=True)
    return found.groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).collect()


def expectation_maximisation(cells: list, types: int) -> np.ndarray:
    """Weights of the three estimates in each bucket; buckets without tokens borrow."""
    weights = np.tile([0.3, 0.4, 0.3], (BUCKETS, 1))
    if not cells:
        return weights
    table = np.array(sorted((r["bucket"], r["pair"], r["word"], r["n"]) for r in cells), float)
    # 1 marks a probability of zero; logs of probabilities are never above 0.
    p = np.stack(
        [np.where(table[:, i] > 0, 0.0, 2.0 ** (table[:, i] / STEPS)) for i in (1, 2)]
        + [np.full(len(table), 1.0 / (types + 1))],
        1,
    )
    n, seen = table[:, 3], np.zeros(BUCKETS, bool)
    for b in range(BUCKETS):
        mine = table[:, 0] == b
        if not mine.any():
            continue
        seen[b] = True
        w = weights[b]
        for _ in range(EM_ROUNDS):
            share = p[mine] * w
            share /= share.sum(1, keepdims=True)
            w = (share * n[mine][:, None]).sum(0) + 1e-3
            w /= w.sum()
        weights[b] = w
    known = np.flatnonzero(seen)
    for b in np.flatnonzero(~seen):
        weights[b] = weights[known[np.abs(known - b).argmin()]]
    # A context that was never seen has no bigram estimate.
    weights[0] = [0.0, weights[0, 1] + weights[0, 0] / 2, weights[0, 2] + weights[0, 0] / 2]
    return weights


def score(docs: DataFrame) -> DataFrame:
    """Base and model scores of every row."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(4, int(2 * partitions - 1).bit_length())
    answers = stored(_answers(_packets(docs, bits)), "counts")
    totals = {
        bool(r["base"]): (int(r["types"] or 0), int(r["tokens"] or 0))
        for r in answers.where("block < 0")
        .groupBy((F.col("part") < 0).alias("base"))
        .agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens"))
        .collect()
    }
    model = Model(totals.get(False, (0, 0)), totals.get(True, (0, 0)))
    model.weights = expectation_maximisation(_held_out_cells(docs, answers, model), model.base[0])
    schema = with_fields(
        docs,
        ["doc_id"],
        "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )

    def scores(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        n = rows.num_rows
        tokens = Tokens(_text(rows))
        counts = Counts(tokens, found, "train")
        types, total = model.train
        base = np.log10((counts.word + 0.1) / (total + 0.1 * (types + 1)))
        pair, word, rest = _parts_of(counts, model.train)
        w = model.weights[_bucket(counts.context)]
        own = np.log10(w[:, 0] * pair + w[:, 1] * word + w[:, 2] * rest)
        return pa.Table.from_arrays(
            [rows.column("doc_id"), pa.array(rows.column("fold").to_numpy() == HELD_OUT),
             pa.array(np.bincount(tokens.row, minlength=n).astype(np.int64)),
             pa.array(np.bincount(tokens.row, counts.word > 0, n).astype(np.int64)),
             pa.array(np.full(n, total, np.int64)),
             pa.array(np.bincount(tokens.row, base, n)), pa.array(np.bincount(tokens.row, own, n))],
            names=schema.names,
        )

    return _with_answers(docs, answers, "train", scores, schema)
