"""Hard-negative mining: exact integer scores of anchors against all rows, by Strassen tiles.

Rows with a NULL label, a NULL vector, or any NULL, NaN or infinite component take no part.
Where ``vec_id`` is divisible by 7 the label first becomes ``(label + 1) % 10``. Each
component ``x`` becomes ``floor(256 * x)`` (as double), so every score, the inner product of
two rows, is an exact integer. Rows whose ``vec_id`` is divisible by 100 are anchors.

Scores order higher first, ties by smaller ``vec_id``. An anchor's positives are its first
``POSITIVES`` other rows (another ``vec_id``) of its label. For each anchor and positive the
negatives are the first ``NEGATIVES`` rows of another label whose score ``s`` lies in the window
``80 * p <= 100 * s <= 100 * p`` of the positive's score ``p`` (none if ``p`` is negative).

How: anchors and candidates are cut into tiles of at most ``ANCHOR_TILE`` and ``CANDIDATE_TILE``
rows by a hash of each row; every pair of tiles meets once in one task (anchors are repeated
for each candidate tile and candidates for each anchor tile; a block join of the stated query
set against all rows, no pair within a group). A task multiplies its int64 tiles by Strassen's
recursion (seven products of halves instead of eight, zero padding to even sizes, plain
products below ``LEAF``) with exact integer additions: when the bound on sums and products
could leave int64, the tile is worked out in Python integers. Each task keeps only heaps: the
best ``POSITIVES`` rows per anchor (first pass), then, once the positives are known, the best
``NEGATIVES`` rows per anchor, positive and window (second pass). Heaps are mergeable, so the
final ones are the first rows of the union of those of all tiles (a window with a row limit,
which Spark also applies before its shuffle).

Defined cases: rows repeated whole count once. Two different rows with one ``vec_id`` both take
part and stay apart (neither is the other's positive when one is an anchor); ties between
them follow a hash of the whole row. Vectors of different lengths are zero-padded to the longer;
an empty vector scores 0. An anchor without positives gives no row; a positive without
negatives gives no row. A row without an id is no anchor and no positive; as a negative it comes
last of its ties, with a NULL id. An empty table gives no row. Extra columns are ignored. A score
outside the long range raises an error, as the same sum in SQL would.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolode.llm.common import stored

POSITIVES = 5
NEGATIVES = 5
# Window of a negative's score s for a positive's score p: LOW * p <= 100 * s <= HIGH * p.
LOW, HIGH = 80, 100
# Rows of one anchor tile and one candidate tile; a task holds one tile of each and their scores.
ANCHOR_TILE = 512
CANDIDATE_TILE = 4096
# Below this size (of the smallest side) Strassen's recursion stops.
LEAF = 32
# Stands for a missing id inside the tiles; last of its ties.
NO_ID = (1 << 63) - 1


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` for integer (or Python-integer object) matrices by Strassen's recursion."""
    m, k = a.shape
    n = b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    pm, pk, pn = m + m % 2, k + k % 2, n + n % 2
    if (pm, pk, pn) != (m, k, n):
        a = np.pad(a, ((0, pm - m), (0, pk - k)))
        b = np.pad(b, ((0, pk - k), (0, pn - n)))
    hm, hk, hn = pm // 2, pk // 2, pn // 2
    a11, a12, a21, a22 = a[:hm, :hk], a[:hm, hk:], a[hm:, :hk], a[hm:, hk:]
    b11, b12, b21, b22 = b[:hk, :hn], b[:hk, hn:], b[hk:, :hn], b[hk:, hn:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    c = np.empty((pm, pn), dtype=p1.dtype)
    c[:hm, :hn] = p1 + p4 - p5 + p7
    c[:hm, hn:] = p3 + p5
    c[hm:, :hn] = p2 + p4
    c[hm:, hn:] = p1 - p2 + p3 + p6
    return c[:m, :n]


def _levels(m: int, k: int, n: int) -> int:
    levels = 0
    while min(m, k, n) > LEAF:
        m, k, n = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
        levels += 1
    return levels


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of ``floor(256 * x)``, zero-padded to ``width``; Python integers if int64 is short."""
    scaled = [np.floor(256.0 * np.asarray(v, dtype=np.float64)) for v in vectors]
    out = np.zeros((len(scaled), width), dtype=np.float64)
    for i, v in enumerate(scaled):
        out[i, : len(v)] = v
    return out


def scores(anchors: pd.Series, candidates: pd.Series) -> np.ndarray:
    """Exact integer inner products of every anchor with every candidate."""
    width = max([len(v) for v in anchors] + [len(v) for v in candidates] + [0])
    a, c = _matrix(anchors, width), _matrix(candidates, width).T
    if a.size == 0 or c.size == 0:
        return np.zeros((a.shape[0], c.shape[1]), dtype=np.int64)
    # A level of the recursion at most doubles an entry of either side and adds up to four
    # products: a generous bound on every value met, operands, products and sums.
    grow = 8 ** _levels(a.shape[0], width, c.shape[1])
    bound = width * float(np.abs(a).max()) * float(np.abs(c).max()) * grow
    if bound < 2.0**62:
        return strassen(a.astype(np.int64), c.astype(np.int64))
    exact = strassen(
        np.vectorize(int, otypes=[object])(a), np.vectorize(int, otypes=[object])(c)
    )
    if exact.size and (max(exact.flat) >= 2**63 or min(exact.flat) < -(2**63)):
        raise OverflowError("a score leaves the long range")
    return exact.astype(np.int64)


def _first(values: np.ndarray, ids: np.ndarray, keys: np.ndarray, mask: np.ndarray, k: int):
    """Indexes of the first ``k`` columns allowed by ``mask``: higher value, then smaller id, key."""
    at = np.flatnonzero(mask)
    # The complement falls as a value rises and, unlike the negative, exists for every long.
    falling = ~values[at]
    if len(at) > k:
        # Keep every column that ties the k-th value, then order exactly.
        near = falling <= np.partition(falling, k - 1)[k - 1]
        at, falling = at[near], falling[near]
    order = np.lexsort((keys[at], ids[at], falling))
    return at[order[:k]]


def window(positive_score: int) -> tuple[int, int]:
    """Least and greatest score of a negative, in whole numbers: 100 * s may leave int64."""
    p = int(positive_score)
    return -(-LOW * p // 100), HIGH * p // 100


def positives_in_tile(anchors: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
    """Per anchor of the tile, its best rows of the same label among the tile's candidates."""
    s = scores(anchors["vec"], candidates["vec"])
    ids, keys, labels, named = (candidates[c].to_numpy() for c in ("vec_id", "key", "label", "named"))
    out = []
    for i, (aid, akey, alabel) in enumerate(anchors[["vec_id", "key", "label"]].itertuples(index=False)):
        mask = (labels == alabel) & (ids != aid) & named
        for j in _first(s[i], ids, keys, mask, POSITIVES):
            out.append((aid, akey, int(ids[j]), int(keys[j]), int(s[i, j])))
    return pd.DataFrame(
        out, columns=["anchor_id", "anchor_key", "positive_id", "positive_key", "positive_score"]
    )


def negatives_in_tile(anchors: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
    """Per anchor and positive of the tile, its best rows of another label in the window."""
    s = scores(anchors["vec"], candidates["vec"])
    ids, keys, labels, named = (candidates[c].to_numpy() for c in ("vec_id", "key", "label", "named"))
    out = []
    for i, row in enumerate(anchors.itertuples(index=False)):
        other = labels != row.label
        for pid, pkey, p in zip(row.positive_ids, row.positive_keys, row.positive_scores):
            low, high = window(p)
            # Of a negative score nothing lies in the window; low could leave int64 only there.
            mask = other & (s[i] >= low) & (s[i] <= high) if p >= 0 else np.zeros(len(other), bool)
            for j in _first(s[i], ids, keys, mask, NEGATIVES):
                out.append(
                    (row.vec_id, row.key, int(pid), int(pkey), int(p), int(ids[j]) if named[j] else None,
                     int(keys[j]), int(s[i, j]))
                )
    # Objects: a missing id must not turn the other ids into doubles.
    return pd.DataFrame(
        out,
        columns=[
            "anchor_id", "anchor_key", "positive_id", "positive_key", "positive_score",
            "negative_id", "negative_key", "negative_score",
        ],
        dtype=object,
    )


def rows_of(embeddings: DataFrame) -> DataFrame:
    """Rows that take part, once each: vec_id, label (shifted where the id is divisible by 7),
    key (a hash of the whole row: tiles and the last tie-break) and the vector as doubles,
    cut down to whole 256ths, which its score is made of. Without an id: not ``named``, last."""
    valid = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))

    def floored(x: Column) -> Column:
        y = 256 * x.cast("double")
        # A double of 2^53 or more is whole, and might not fit the long that floor gives.
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y) / 256

    return (
        embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & valid)
        .select(
            F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"),
            F.col("vec_id").isNotNull().alias("named"),
            label.cast("int").alias("label"),
            F.transform("embedding", floored).alias("vec"),
        )
        .dropDuplicates(["vec_id", "named", "label", "vec"])
        .withColumn("key", F.xxhash64("vec_id", "named", "label", "vec"))
        .select("vec_id", "named", "label", "key", "vec")
    )


def _tiled(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int):
    """Anchors and candidates keyed by (anchor tile, candidate tile), each pair of tiles once.

    Both sides have int keys: a long and an int of one value hash to different partitions, and
    the two sides of a tile would never meet.
    """
    across = max(1, -(-n_anchors // ANCHOR_TILE))
    down = max(1, -(-n_rows // CANDIDATE_TILE))
    a = anchors.withColumn("at", F.pmod("key", F.lit(across)).cast("int")).withColumn(
        "ct", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))
    )
    c = rows.withColumn("ct", F.pmod(F.xxhash64("key"), F.lit(down)).cast("int")).withColumn(
        "at", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))
    )
    return a, c


def _best(df: DataFrame, over: list[str], k: int, score: str, vid: str, key: str) -> DataFrame:
    w = Window.partitionBy(*over).orderBy(F.desc(score), F.asc_nulls_last(vid), F.asc(key))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score."""
    rows = stored(rows_of(embeddings), "negatives-rows")
    anchors = rows.where(F.col("vec_id") % 100 == 0)
    n_rows, n_anchors = rows.count(), anchors.count()
    if n_anchors == 0:
        return rows.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, "
            "positive_score long, negative_score long"
        )
    a, c = _tiled(rows, anchors, n_rows, n_anchors)
    tile = ["at", "ct"]
    local = (
        a.groupBy(*tile)
        .cogroup(c.groupBy(*tile))
        .applyInPandas(
            lambda x, y: positives_in_tile(x, y),
            "anchor_id long, anchor_key long, positive_id long, positive_key long, positive_score long",
        )
    )
    positives = stored(
        _best(local, ["anchor_id", "anchor_key"], POSITIVES, "positive_score", "positive_id", "positive_key"),
        "negatives-positives",
    )
    found = positives.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_key").alias("key")).agg(
        F.collect_list(F.struct("positive_id", "positive_key", "positive_score")).alias("p")
    )
    with_positives = stored(anchors.join(
        found.select(
            "vec_id", "key",
            F.col("p.positive_id").alias("positive_ids"),
            F.col("p.positive_key").alias("positive_keys"),
            F.col("p.positive_score").alias("positive_scores"),
        ),
        ["vec_id", "key"],
    ), "negatives-anchors")
    a, c = _tiled(rows, with_positives, n_rows, n_anchors)
    local = (
        a.groupBy(*tile)
        .cogroup(c.groupBy(*tile))
        .applyInPandas(
            lambda x, y: negatives_in_tile(x, y),
            "anchor_id long, anchor_key long, positive_id long, positive_key long, positive_score long, "
            "negative_id long, negative_key long, negative_score long",
        )
    )
    best = _best(
        local,
        ["anchor_id", "anchor_key", "positive_id", "positive_key"],
        NEGATIVES,
        "negative_score",
        "negative_id",
        "negative_key",
    )
    return best.select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        "negative_id",
        "positive_score",
        "negative_score",
    )


def brute_force(rows: list[tuple[int, int | None, list[float] | None]]) -> list[tuple]:
    """The same rows by plain Python over (vec_id, label, vector) tuples: for tests."""
    seen, kept = set(), []
    for vid, label, vec in rows:
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        # Spark's % takes the dividend's sign, as math.fmod does.
        label = int(math.fmod(label + 1, 10)) if vid % 7 == 0 else label
        ints = tuple(math.floor(256.0 * float(x)) for x in vec)
        if (vid, label, ints) not in seen:
            seen.add((vid, label, ints))
            kept.append((vid, label, ints))

    def dot(u, v):
        return sum(x * y for x, y in zip(u, v))

    out = []
    for aid, alabel, avec in kept:
        if aid % 100:
            continue
        scored = sorted(((dot(avec, v), vid, lab, v) for vid, lab, v in kept), key=lambda t: (-t[0], t[1], t[3]))
        pos = [t for t in scored if t[2] == alabel and t[1] != aid][:POSITIVES]
        for p, pid, _, _ in pos:
            neg = [t for t in scored if t[2] != alabel and LOW * p <= 100 * t[0] <= HIGH * p][:NEGATIVES]
            out.extend((aid, pid, r + 1, nid, p, ns) for r, (ns, nid, _, _) in enumerate(neg))
    return out
