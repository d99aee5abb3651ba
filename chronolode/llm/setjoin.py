"""What the two exact set-similarity joins share: rarity order, prefixes, bounds, components.

Sets are held as 64-bit fingerprints of their elements. Jaccard thresholds are whole
percentages, so every bound is integer arithmetic: two sets of m and n elements match at p
percent if and only if their overlap o has ``100 * o >= p * (m + n - o)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolode.llm.arrays import mix, order_of
from chronolode.llm.common import stored

# Counters of the rarity order; their number does not grow with the data.
COUNTER_BITS = 16
# Binary logarithm of the bits that tell which nodes are needed (2 MB in all).
SEEN_BITS = 24


def counter_of(code: np.ndarray) -> np.ndarray:
    return (code >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def rarity(rows: DataFrame) -> np.ndarray:
    """Sum (counter, n) rows; the rank of each of the 2 ** COUNTER_BITS counters, rarest first."""
    total = np.zeros(1 << COUNTER_BITS, np.int64)
    for r in rows.groupBy("counter").agg(F.sum("n").alias("n")).collect():
        total[r["counter"]] = r["n"]
    rank = np.zeros(len(total), np.uint64)
    rank[np.argsort(total, kind="stable")] = np.arange(len(total), dtype=np.uint64)
    return rank


def may_hold(nodes: DataFrame) -> np.ndarray:
    """Bits, one of which is set for each of the given (node)s; their number is fixed.

    Nodes whose bit is not set are none of the given ones.
    """
    at = F.pmod(F.col("node"), F.lit(1 << SEEN_BITS))
    parts = (
        nodes.groupBy(F.bitmap_bucket_number(at + 1).alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at + 1)).alias("bits"))
        .collect()
    )
    out = np.zeros((1 << SEEN_BITS) // 8, np.uint8)
    for r in parts:
        bits = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["part"] - 1) * len(bits) : r["part"] * len(bits)] = bits
    return out


def seen(node: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which nodes have their bit set in ``bits`` of ``may_hold``."""
    at = node.view(np.uint64) & np.uint64((1 << SEEN_BITS) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def set_ids(row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and fingerprints of the sets of n rows, given as distinct pairs ordered by row."""
    size = np.bincount(row, minlength=n).astype(np.int64)
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(mix(code), out=total[1:])
    end = np.cumsum(size)
    sums = total[end] - total[end - size]
    return size, mix(sums + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def prefixes(
    row: np.ndarray, code: np.ndarray, rank: np.ndarray, size: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, element and place of each set's rarest ``size - ceil(t * size) + 1`` elements.

    Any fixed order of elements makes prefix filtering exact; rarest first makes it cheap.
    Two matching sets share an element of both prefixes.
    """
    order = order_of(row, by_rank(code, rank))
    return prefixes_of(row[order], code[order], size, percent)


def by_rank(code: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Elements that sort by rarity: the counter's rank replaces a code's leading bits, its counter."""
    return (rank[counter_of(code)] << np.uint64(64 - COUNTER_BITS)) | (
        code & np.uint64((1 << (64 - COUNTER_BITS)) - 1)
    )


def prefixes_of(
    row: np.ndarray, code: np.ndarray, size: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``prefixes``, of elements that are ordered by row and rarity."""
    first = np.cumsum(size) - size
    place = np.arange(len(row)) - first[row]
    length = size - -(-size * percent // 100) + 1
    keep = place < length[row]
    return row[keep], code[keep], place[keep]


def least_overlap(m: Column, n: Column, percent: int) -> Column:
    """Smallest overlap with which sets of m and n elements match."""
    return F.ceil(percent * (m + n) / (100 + percent))


def may_match(size_a: Column, left_a: Column, size_b: Column, left_b: Column, percent: int) -> Column:
    """Length and positional filter for two sets that share an element.

    ``left`` is the number of elements from the shared one on. At the first element a
    matching pair shares both conditions hold, so a pair that fails here either does not
    match or is met again at its first shared element.
    """
    return (
        (100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b))
        & (F.least(left_a, left_b) >= least_overlap(size_a, size_b, percent))
    )


def overlap(
    row_a: np.ndarray, code_a: np.ndarray, row_b: np.ndarray, code_b: np.ndarray, n: int
) -> np.ndarray:
    """Elements shared by the a-set and the b-set of each row (both given as distinct pairs)."""
    row = np.concatenate([row_a, row_b])
    code = np.concatenate([code_a, code_b])
    order = order_of(row, code)
    row, code = row[order], code[order]
    twice = (row[1:] == row[:-1]) & (code[1:] == code[:-1])
    return np.bincount(row[1:][twice], minlength=n).astype(np.int64)


def emit_counts(total: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at = np.flatnonzero(total)
    yield at.astype(np.int32), total[at]


def labels_of(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, label) of all nodes in ``links(a, b)``; equal labels mean connected.

    Each round takes the smallest label among the neighbours and then the label of that
    label. Without ``rounds`` it runs until nothing changes, and equal labels are then
    exactly the connected components; with it, labels may be finer.
    """
    both = stored(
        links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links"
    )
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    done = 0
    while rounds is None or done < rounds:
        heard = (
            both.join(labels.withColumnRenamed("node", "a"), "a")
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("label").alias("heard"))
        )
        near = labels.join(heard, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", "heard").alias("near")
        )
        near = stored(near, "labels")
        of = near.select(F.col("node").alias("near"), F.col("near").alias("label"))
        next_labels = stored(
            near.join(of, "near").select("node", "label", (F.col("label") != F.col("old")).alias("new")),
            "labels",
        )
        labels = next_labels.select("node", "label")
        done += 1
        if next_labels.where("new").isEmpty():
            break
    return labels


def int64(codes: np.ndarray) -> pa.Array:
    return pa.array(codes.view(np.int64))
