"""Quality rules: hashed word and character n-gram logistic regression with fixed thresholds.

Features of a text: its words and word pairs (lower case) and runs of three bytes, hashed into
``2 ** BITS`` bins; the square roots of the bin counts, scaled to length one. A logistic
regression is trained on a bounded sample of labelled rows, its margin is turned into a
probability by Platt scaling on rows it was not trained on, and whole texts are scored in
Arrow batches against ``KEEP_FROM``. Base rules run in the same pass.

Defined results: a NULL text has no words and fails the base rules; labels that are NULL or
belong to no document are not used; repeated labels count as often as they occur; without
labels of both kinds the base rules decide alone. Rows are judged each on its own, repeated
or not; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolode.llm.arrays import Words, code_points, mix, per_row
from chronolode.llm.common import map_arrow, with_fields

BITS = 15
# Labelled rows the regression may use at most; one in five calibrates it.
SAMPLE = 2500
KEEP_FROM = 0.5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5
PENALTY = 1e-4
ROUNDS = 120
ROWS = 64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def _bins(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and bin of every feature occurrence."""
    keep = np.uint64(64 - BITS)
    pairs, at = words.ngrams(2)
    data = words.data.astype(np.uint64)
    n = max(len(data) - 2, 0)
    row_of = np.repeat(np.arange(words.rows), np.diff(words.offsets))
    inside = row_of[:n] == row_of[2:]
    code = (data[:n] << np.uint64(16)) | (data[1 : n + 1] << np.uint64(8)) | data[2:]
    code = code[inside] * np.uint64(0x9E3779B97F4A7C15)
    return (
        np.concatenate([words.row, words.row[at], row_of[:n][inside]]),
        np.concatenate([words.hash >> keep, mix(pairs + np.uint64(1)) >> keep, code >> keep]).astype(
            np.int64
        ),
    )


def _matrix(words: Words) -> list[np.ndarray]:
    """Dense feature rows, a few at a time."""
    row, bins = _bins(words)
    order = np.argsort(row, kind="stable")
    row, bins = row[order], bins[order]
    out = []
    for a in range(0, words.rows, ROWS):
        b = min(a + ROWS, words.rows)
        i, j = np.searchsorted(row, [a, b])
        flat = np.bincount(((row[i:j] - a) << BITS) + bins[i:j], minlength=(b - a) << BITS)
        x = np.sqrt(flat.reshape(b - a, -1).astype(np.float32))
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        out.append(x / np.maximum(norm, 1e-9))
    return out


def base_counts(words: Words) -> dict[str, np.ndarray]:
    """Base measures per row, as int64."""
    n = words.rows
    points = code_points(words.data, words.offsets)
    symbols = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(_SYMBOL[words.data], out=symbols[1:])
    start, end, line_row = words.lines()
    full = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, line_row = start[full], end[full], line_row[full]
    line = words.span_hash(start, end) ^ mix(line_row.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(line, return_index=True)
    grams, at = words.ngrams(WINDOW)
    mine = grams ^ mix(words.row[at].astype(np.uint64) + np.uint64(1))
    _, place, times = np.unique(mine, return_inverse=True, return_counts=True)
    repeated = at[times[place] > 1]
    cover = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(cover, repeated, 1)
    np.add.at(cover, repeated + WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0
    lengths = points[words.end] - points[words.start]
    return {
        "n_words": words.count().astype(np.int64),
        "word_chars": np.bincount(words.row, lengths, minlength=n).astype(np.int64),
        "n_symbols": symbols[words.offsets[1:]] - symbols[words.offsets[:-1]],
        "n_dup_lines": per_row(line_row, n) - per_row(line_row[first], n),
        "n_repeat_words": per_row(words.row[covered], n),
    }


def _train(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the sparse rows (bins, values) and 0/1 labels."""
    starts = np.cumsum([0, *(len(b) for b, _ in x)])[:-1]
    bins = np.concatenate([b for b, _ in x])
    values = np.concatenate([v for _, v in x])
    row = np.repeat(np.arange(len(x)), [len(b) for b, _ in x])
    w, bias = np.zeros(1 << BITS), 0.0
    aim, aim_bias = w.copy(), bias
    for k in range(ROUNDS):
        margin = np.add.reduceat(aim[bins] * values, starts) + aim_bias
        error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y) / len(y)
        # Rows have length one, so curvature is at most a quarter (a half with the bias).
        step = aim - 2 * (np.bincount(bins, values * error[row], 1 << BITS) + PENALTY * aim)
        step_bias = aim_bias - 2 * error.sum()
        pull = k / (k + 3)
        aim, aim_bias = step + pull * (step - w), step_bias + pull * (step_bias - bias)
        w, bias = step, step_bias
    return w, bias


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibrated probability, by Newton steps on smoothed targets."""
    good, bad = y.sum(), (1 - y).sum()
    goal = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    at = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -40, 40)))
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        at = at - np.linalg.solve(bend, x.T @ (p - goal))
    return float(at[0]), float(at[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Train on the ``sample`` labelled rows first in a hash order of their ids."""
    drawn = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("labelled"), "quality", F.xxhash64("doc_id").alias("draw"))
        .orderBy("draw", "quality")
        .limit(sample)
    )
    rows = docs.select("doc_id", "text").join(drawn, F.col("doc_id") == F.col("labelled"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column("text"), lower=True)
        bins, values = [], []
        for x in _matrix(words):
            for r in x:
                at = np.flatnonzero(r)
                bins.append(at.astype(np.int32).tobytes())
                values.append(r[at].astype(np.float32).tobytes())
        return pa.RecordBatch.from_arrays(
            [batch.column("draw"), batch.column("quality").cast(pa.int32()),
             pa.array(bins, pa.binary()), pa.array(values, pa.binary())],
            names=["draw", "quality", "bins", "vals"],
        )

    found = map_arrow(
        rows.select("draw", "quality", "text"), step, "draw long, quality int, bins binary, vals binary"
    ).collect()
    found.sort(key=lambda r: (r["draw"], r["quality"], bytes(r["bins"])))
    x = [(np.frombuffer(r["bins"], np.int32), np.frombuffer(r["vals"], np.float32)) for r in found]
    y = np.array([float(r["quality"] > 0) for r in found])
    some = np.array([len(b) > 0 for b, _ in x], bool)
    x, y = [r for r, ok in zip(x, some) if ok], y[some] if len(y) else y
    test = np.arange(len(y)) % 5 == 4
    if len(set(y[~test])) < 2:
        return None
    w, bias = _train([r for r, t in zip(x, test) if not t], y[~test])
    margin = np.array([float(w[b] @ v) + bias for b, v in (r for r, t in zip(x, test) if t)])
    slope, shift = _platt(margin, y[test]) if len(set(y[test])) == 2 else (1.0, 0.0)
    return Model(w.astype(np.float32), bias, slope, shift)


def judge(docs: DataFrame, model: Model | None) -> DataFrame:
    """Base measures, probability of good quality and verdict of every row."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column("text"))
        base = base_counts(words)
        failed = (base["n_words"] < LEAST_WORDS) | (
            100 * base["n_repeat_words"] > MOST_REPEATED_PERCENT * base["n_words"]
        )
        probability = np.ones(words.rows)
        if model is not None:
            lower = Words(batch.column("text"), lower=True)
            margin = np.concatenate([x @ model.weights for x in _matrix(lower)])
            probability = model.probability(margin.astype(np.float64) + model.bias)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(v) for v in base.values()), pa.array(failed),
             pa.array(~failed & (probability >= KEEP_FROM)), pa.array(probability)],
            names=["doc_id", *base, "base_failed", "kept", "quality_probability"],
        )

    schema = with_fields(
        docs,
        ["doc_id"],
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, quality_probability double",
    )
    return map_arrow(docs.select("doc_id", "text"), step, schema)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, fit(docs, labels))
