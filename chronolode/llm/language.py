"""Language identification with blended-spectrum presence kernels.

A text is the set of its character n-grams of 1 to 3 characters (lower case, any other
character than a letter counts as a space). The kernel of two texts is the number of n-grams
they share, divided by the geometric mean of their set sizes. Landmarks (a bounded, fixed
number of training texts per language) give the Nystrom feature map
``K(landmarks, landmarks)^-1/2 K(landmarks, x)``; one-versus-rest kernel ridge regression on
it is solved on a bounded sample of labelled rows. Scoring is one matrix product per batch:
presence rows times the landmarks' presence columns, times the learned weights. N-grams that
no landmark has cannot be shared and are left out of the sets.

Defined results: ``und`` with score 0 for a NULL text, an empty text and a text without a
letter, and for all texts if nothing could be learned from; otherwise a language that occurs
in the training rows. The score is the winning ridge output (target +1 against -1) moved to
0..1; above one half its classifier claims the text. Equal outputs go to the language first
in code point order. Repeated rows are predicted each on its own, extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolode.llm.common import fold, map_arrow, stored, with_fields

UNKNOWN = "und"
# Expected number of sampled training rows and landmarks per language.
SAMPLE = 400
LANDMARKS = 40
RIDGE = 1e-2
# Characters of the longest n-grams; codes of three fit 64 bits with any alphabet.
ORDERS = 3
# Presence rows of one matrix product.
ROWS = 64


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _letters(text: str) -> str:
    return "".join(sorted({c for c in set(text.lower()) if c.isalpha()}))


@dataclass
class Model:
    """Alphabet, n-gram numbers, landmark presences and weights; of bounded size."""

    langs: list[str]
    letter: np.ndarray  # code point -> letter number, 0: none of the landmarks' letters
    base: int
    codes: list[np.ndarray]  # sorted n-gram codes of the landmarks, per n; columns in this order
    landmarks: np.ndarray  # columns x landmarks, float32
    norms: np.ndarray
    weights: np.ndarray | None = None

    def presences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """0/1 matrix of texts by n-grams, and for each text whether it has a letter."""
        out = np.zeros((len(texts), self.landmarks.shape[0] + 1), np.float32)
        lettered = np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            ids = self.letter[np.minimum(_points(text), len(self.letter) - 1)]
            lettered[i] = bool(ids.any()) or any(c.isalpha() for c in set(text))
            code, column = ids, 0
            for n, known in enumerate(self.codes):
                if n:
                    code = code[:-1] * self.base + ids[n:]
                at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
                if len(known):
                    # N-grams of no landmark go to the spare last column.
                    out[i, np.where(known[at] == code, column + at, -1)] = 1
                column += len(known)
        return out[:, :-1], lettered

    def kernel(self, presence: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(presence.sum(1, keepdims=True), 1))
        return (presence @ self.landmarks) / size / self.norms


def _empty_model(langs: list[str], texts: list[str]) -> Model:
    """Model without weights: n-gram columns and presences of the landmark texts."""
    alphabet = sorted({ord(c) for t in texts for c in _letters(t) if ord(c) < 0x10000})
    letter = np.zeros(0x10001, np.int64)
    letter[alphabet] = np.arange(1, len(alphabet) + 1)
    base = len(alphabet) + 1
    model = Model(langs, letter, base, [], np.zeros((0, 0), np.float32), np.ones(1))
    for n in range(1, ORDERS + 1):
        found = set()
        for t in texts:
            ids = letter[np.minimum(_points(t), 0x10000)]
            code = ids
            for k in range(1, n):
                code = code[:-1] * base + ids[k:]
            found.update(np.unique(code).tolist())
        model.codes.append(np.array(sorted(found), np.int64))
    columns = sum(len(codes) for codes in model.codes)
    model.landmarks = np.zeros((columns, 0), np.float32)
    model.landmarks = model.presences(texts)[0].T.copy()
    model.norms = np.sqrt(np.maximum(model.landmarks.sum(0), 1))
    return model


def fit(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model | None:
    """Learn from the rows with a language; None if there is none.

    Rows are drawn by a hash of id and text, about ``sample`` for each language, however
    many rows there are, and thinned to at most ``sample`` on the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    share = known.groupBy(F.col("lang").alias("of")).agg(
        (F.lit(2.0**62 * sample) / F.count(F.lit(1))).alias("below")
    )
    order = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
    # Only ids of the draw meet the shares; the texts are then picked by the few drawn ones,
    # a table of known size, without a shuffle of the corpus.
    chosen = stored(
        known.select("lang", order.alias("draw"))
        .join(share, F.col("lang") == F.col("of"))
        .where(F.col("draw") < F.col("below"))
        .select("of", F.col("draw").alias("drawn"))
        .distinct(),
        "drawn",
    )
    drawn = known.select("lang", "text", order.alias("draw")).join(
        chosen, (F.col("lang") == F.col("of")) & (F.col("draw") == F.col("drawn")), "left_semi"
    )
    marks = (
        chosen.groupBy(F.col("of").alias("lang"))
        .agg(F.slice(F.array_sort(F.collect_set("drawn")), 1, sample).alias("draws"))
        .collect()
    )
    if not marks:
        return None
    langs = sorted(r["lang"] for r in marks)
    chosen = [d for r in marks for d in r["draws"][:landmarks]]
    texts = [
        r["text"]
        for r in drawn.where(F.col("draw").isin(chosen)).dropDuplicates(["draw"]).orderBy("draw").collect()
    ]
    model = _empty_model(langs, texts)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column("text").to_pylist()
        kernel = np.concatenate(
            [model.kernel(model.presences(rows[i : i + ROWS])[0]) for i in range(0, len(rows), ROWS)]
        )
        return pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("draw"), pa.array(kernel.tolist(), pa.list_(pa.float64()))],
            names=["lang", "draw", "kernel"],
        )

    allowed = {d for r in marks for d in r["draws"]}
    rows = [
        r
        for r in map_arrow(drawn, step, "lang string, draw long, kernel array<double>").collect()
        if r["draw"] in allowed
    ]
    rows.sort(key=lambda r: (r["draw"], r["lang"]))
    k_rows = np.array([r["kernel"] for r in rows])
    goal = np.array([[1.0 if r["lang"] == lang else -1.0 for lang in langs] for r in rows])
    k_marks = model.kernel(model.landmarks.T).astype(np.float64)
    values, vectors = np.linalg.eigh((k_marks + k_marks.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = np.hstack([k_rows @ root, np.ones((len(rows), 1))])
    # One-versus-rest: both sides of each classifier weigh the same.
    weights = []
    for j in range(len(langs)):
        mine = goal[:, j] > 0
        w = np.where(mine, 0.5 / max(mine.sum(), 1), 0.5 / max((~mine).sum(), 1))
        left = features.T @ (features * w[:, None]) + RIDGE / len(rows) * np.eye(features.shape[1])
        weights.append(np.linalg.solve(left, features.T @ (w * goal[:, j])))
    weights = np.array(weights).T
    model.weights = np.vstack([root @ weights[:-1], weights[-1:]]).astype(np.float32)
    return model


def predict(docs: DataFrame, model: Model | None, keep_row: bool = False) -> DataFrame:
    """doc_id, lang_pred and score of every row; with ``keep_row`` also the row as ``row``."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        names, scores = [], []
        for i in range(0, len(texts), ROWS):
            part = texts[i : i + ROWS]
            if model is None:
                names += [UNKNOWN] * len(part)
                scores += [0.0] * len(part)
                continue
            presence, lettered = model.presences(part)
            out = model.kernel(presence) @ model.weights[:-1] + model.weights[-1]
            best = out.argmax(1)
            names += [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
            top = np.clip((out[np.arange(len(part)), best] + 1) / 2, 0, 1)
            scores += np.where(lettered, top, 0).tolist()
        kept = [batch.column("doc_id")] + ([batch.column("row")] if keep_row else [])
        return pa.RecordBatch.from_arrays(
            [*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
            names=["doc_id", *(["row"] if keep_row else []), "lang_pred", "score"],
        )

    kept = ["doc_id"]
    if keep_row:
        docs = docs.select("doc_id", "text", F.struct("*").alias("row"))
        kept.append("row")
    schema = with_fields(docs, kept, "lang_pred string, score double")
    return map_arrow(docs.select(*kept, "text"), step, schema)


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Predict all rows, learning only from those outside the held-out fold."""
    held_out = fold(F.col("doc_id"), folds) == 0
    model = fit(docs.where(~held_out))
    return predict(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def accepted(docs: DataFrame, least: float = 0.5, folds: int = 5) -> DataFrame:
    """Rows whose language is known: not ``und``, and claimed by the winning classifier."""
    held_out = fold(F.col("doc_id"), folds) == 0
    model = fit(docs.where(~held_out))
    return (
        predict(docs, model, keep_row=True)
        .where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
        .select("row.*")
    )
