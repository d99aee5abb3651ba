"""N-gram Jaccard join as a metric-space join: pivots, regions, windows, recursion.

Documents are sets of 5-word shingles under the Jaccard distance, a metric. Random documents
all lie at distance 1 from each other and from any pivot document, so document pivots alone
separate nothing. The join therefore has two levels of pivots:

1. Single shingles are the first pivots (one-shingle sets, at distance ``1 - 1/n`` of the
   documents that hold them and 1 of all others). A document's Voronoi cell is that of its
   rarest shingle. A document within the threshold may have any of the first
   ``n - ceil(t * n) + 1`` as its nearest pivot; the triangle inequality gives this window,
   and the document is replicated to just these regions. Matching documents meet in one.
2. Inside a region a document is the pivot: all others are compared with it. Those within the
   threshold are connected through it and need no comparison among each other; the rest forms
   smaller regions, joined again with other pivots (``ROUNDS`` times), and what is left is
   joined pair by pair within the windows of sizes, positions and distances to the pivot.

Before texts travel, the two images of a pair are compared: a shingle flips one bit of its
set's image, so the differing bits are at most the differing shingles and a pair that cannot
match is told from an eighth to a quarter of a byte per shingle. Its distance is then known from
below, which the window around the pivot takes into account.

Every region is split by keys alone and nothing is capped: all links that could join two
different components are verified on whole texts, so components are exact. Copies are
collapsed first; shingle counts (for rarity) and everything else cover all documents.

Defined results: a text with fewer than five words is one shingle, its whole word sequence; a
NULL, empty or blank text is the empty set, linked with nothing, and its component is its own
id. Rows with equal sets (repeated rows too) are one node. A NULL id never is a component's
id unless all its ids are NULL. An empty table gives no row; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronolode.llm.arrays import Words, mix, sets
from chronolode.llm.common import WORD, map_arrow, stored, text_steps, with_fields
from chronolode.llm.setjoin import (
    COUNTER_BITS,
    counter_of,
    emit_counts,
    int64,
    labels_of,
    may_hold,
    may_match,
    overlap,
    prefixes,
    rarity,
    seen,
    set_ids,
)

SHINGLE = 5
PERCENT = 75
ROUNDS = 3
# Rows of one region that a task holds at most.
LONG_RUN = 16_384
# Bits of the smallest image; larger sets have as many as elements, rounded up to a power of two.
LEAST_BITS = 64


def shingle_sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle) pairs of a batch of texts, ordered."""
    words = Words(text, lower=True)
    count = words.count()
    code, at = words.ngrams(SHINGLE)
    row, codes = [words.row[at]], [code]
    for n in range(1, SHINGLE):
        if (count == n).any():
            code, at = words.ngrams(n)
            whole = count[words.row[at]] == n
            row.append(words.row[at[whole]])
            codes.append(code[whole])
    return sets(np.concatenate(row), np.concatenate(codes))


def _nodes(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles, node) of all rows, and the rarity ranks of the corpus' shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for part in text_steps(batch):
                row, code = shingle_sets(part.column("text"))
                size, node = set_ids(row, code, part.num_rows)
                total += np.bincount(counter_of(code), minlength=len(total))
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size),
                     pa.array(node.view(np.int64), mask=size == 0), none.cast(pa.int32()), none],
                    names=["doc_id", "n_shingles", "node", "counter", "n"],
                )
        if kind is not None:
            for at, n in emit_counts(total):
                none = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(at), kind), none, none, pa.array(at), pa.array(n)],
                    names=["doc_id", "n_shingles", "node", "counter", "n"],
                )

    schema = with_fields(docs, ["doc_id"], "n_shingles long, node long, counter int, n long")
    both = stored(docs.select("doc_id", "text").mapInArrow(run, schema), "nodes")
    ranks = rarity(both.where("counter is not null"))
    return both.where("counter is null").select("doc_id", "n_shingles", "node"), ranks


def _regions(docs: DataFrame, ranks: np.ndarray, percent: int) -> DataFrame:
    """(key, node, size, left): nodes replicated to the regions of their window.

    A task sends a node that it meets again only once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for part in text_steps(batch):
                row, code = shingle_sets(part.column("text"))
                size, node = set_ids(row, code, part.num_rows)
                fresh = np.zeros(len(size), bool)
                for i, name in enumerate(node.tolist()):
                    if size[i] and name not in met:
                        met.add(name)
                        fresh[i] = True
                keep = fresh[row]
                number = np.flatnonzero(fresh)
                at = np.cumsum(fresh) - 1
                row, code, place = prefixes(at[row[keep]], code[keep], ranks, size[fresh], percent)
                row = number[row]
                yield pa.RecordBatch.from_arrays(
                    [int64(code), int64(node[row]), pa.array(size[row].astype(np.int32)),
                     pa.array((size[row] - place).astype(np.int32))],
                    names=["key", "node", "size", "left"],
                )

    return docs.select("text").mapInArrow(run, "key long, node long, size int, left int")


def _members(regions: DataFrame) -> DataFrame:
    """(key, node, size, left): regions with more than one node, equal regions only once.

    After one shuffle by shingle the sorted rows stream by. Near copies share many shingles
    and so meet in many regions of the same nodes; a region is therefore renamed to a
    fingerprint of its nodes, and regions of one name are merged (with the largest ``left``
    of each node, which keeps every pair the filters would let pass). Regions of more than
    ``LONG_RUN`` rows are not held; they keep their shingle as name.
    """
    names = ["key", "node", "size", "left"]

    def emit(rows: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=names)

    def whole(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, node = rows[0], rows[1]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, size, left = (r[fresh] for r in rows)
        start = np.ones(len(key), bool)
        start[1:] = key[1:] != key[:-1]
        run = np.cumsum(start) - 1
        length = np.bincount(run)
        total = np.zeros(len(key) + 1, np.uint64)
        np.cumsum(mix(node.view(np.uint64)), out=total[1:])
        end = np.cumsum(length)
        name = mix(total[end] - total[end - length] + length.astype(np.uint64)).view(np.int64)[run]
        keep = length[run] > 1
        name, node, size, left = name[keep], node[keep], size[keep], left[keep]
        # Merge equal regions of this stretch; the rest is merged after the next shuffle.
        order = np.lexsort((-left, node, name))
        name, node, size, left = name[order], node[order], size[order], left[order]
        best = np.ones(len(name), bool)
        best[1:] = (name[1:] != name[:-1]) | (node[1:] != node[:-1])
        yield emit([name[best], node[best], size[best], left[best]])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size, long_key = 0, None
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in names])
            size += batch.num_rows
            if size < LONG_RUN:
                continue
            rows = [np.concatenate(c) for c in zip(*held)]
            if long_key is not None:
                cut = int(np.searchsorted(rows[0], long_key, "right"))
                yield emit([r[:cut] for r in rows])
                rows = [r[cut:] for r in rows]
                long_key = None if len(rows[0]) else long_key
            if len(rows[0]):
                cut = int(np.searchsorted(rows[0], rows[0][-1]))
                if cut:
                    yield from whole([r[:cut] for r in rows])
                rows = [r[cut:] for r in rows]
                if len(rows[0]) >= LONG_RUN:
                    long_key = rows[0][0]
                    yield emit(rows)
                    rows = [r[:0] for r in rows]
            held, size = [rows], len(rows[0])
        rows = [np.concatenate(c) for c in zip(*held)] if held else None
        if rows is not None and long_key is not None:
            cut = int(np.searchsorted(rows[0], long_key, "right"))
            yield emit([r[:cut] for r in rows])
            rows = [r[cut:] for r in rows]
        if rows is not None and len(rows[0]):
            yield from whole(rows)

    return (
        regions.repartition("key")
        .sortWithinPartitions("key", "node")
        .mapInArrow(stream, "key long, node long, size int, left int")
        .groupBy("key", "node")
        .agg(F.max("size").alias("size"), F.max("left").alias("left"))
    )


def images_of(row: np.ndarray, code: np.ndarray, size: np.ndarray) -> pa.Array:
    """Image of each set, in words of 64 bits: whether an odd number of elements falls on a bit."""
    width = np.full(len(size), LEAST_BITS, np.int64)
    while (short := width < size).any():
        width[short] *= 2
    end = np.cumsum(width)
    total = int(end[-1]) if len(end) else 0
    bit = (end - width)[row] + (code & (width[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(bit, minlength=total) & 1).astype(np.uint8)
    offsets = np.concatenate([[0], end // 64]).astype(np.int32)
    bits = np.packbits(odd, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(bits))


def differing(one: Column, two: Column) -> Column:
    """Bits in which two images differ, one of twice the width folded to the other's.

    Images further apart tell nothing (0); sets of such sizes do not match at 50 percent or more.
    """
    words = F.least(F.size(one), F.size(two))

    def word(image: Column, i: Column) -> Column:
        second = F.when(F.size(image) > words, F.element_at(image, i + words)).otherwise(F.lit(0))
        return F.element_at(image, i).bitwiseXOR(second)

    return F.when(
        F.greatest(F.size(one), F.size(two)) <= 2 * words,
        F.aggregate(
            F.sequence(F.lit(1), words),
            F.lit(0),
            lambda n, i: n + F.bit_count(word(one, i).bitwiseXOR(word(two, i))),
        ),
    ).otherwise(F.lit(0))


def most_overlap(m: Column, n: Column, one: Column, two: Column) -> Column:
    """Elements that sets of m and n elements with these images share at most."""
    return F.least(m, n, F.shiftright(m + n - differing(one, two), 1))


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, size, image, text) of the given nodes, once for each task that has it, and few others."""
    bits = may_hold(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for part in text_steps(batch):
                row, code = shingle_sets(part.column("text"))
                size, node = set_ids(row, code, part.num_rows)
                fresh = np.zeros(len(size), bool)
                for i in np.flatnonzero((size > 0) & seen(node, bits)).tolist():
                    name = int(node[i])
                    if name not in met:
                        met.add(name)
                        fresh[i] = True
                keep = fresh[row]
                number = np.cumsum(fresh) - 1
                image = images_of(number[row[keep]], code[keep], size[fresh])
                text = part.column("text").filter(pa.array(fresh))
                yield pa.RecordBatch.from_arrays(
                    [int64(node[fresh]), pa.array(size[fresh]), image, text],
                    names=["node", "size", "image", "text"],
                )

    return docs.select("text").mapInArrow(run, "node long, size long, image array<long>, text string")


def _compared(pairs: DataFrame, images: DataFrame, percent: int) -> DataFrame:
    """(a, b, low, close): what the images tell of each pair.

    ``low`` is a distance that the pair has at least; a pair that is not ``close`` cannot match.
    """
    one = images.select(F.col("node").alias("a"), F.col("size").alias("m"), "image")
    two = images.select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("image").alias("other"))
    either = F.col("m") + F.col("n") - F.col("most")
    return (
        pairs.join(one, "a")
        .join(two, "b")
        .withColumn("most", most_overlap(F.col("m"), F.col("n"), F.col("image"), F.col("other")))
        .select(
            "a", "b", (1 - F.col("most") / either).alias("low"),
            (100 * F.col("most") >= percent * either).alias("close"),
        )
    )


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, both, either): overlap and union of each pair, from whole texts.

    Only texts of the pairs leave the task that reads them, but for few others.
    """
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    bits = may_hold(needed)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(seen(batch.column("node").to_numpy(), bits)))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        row_a, code_a = shingle_sets(batch.column("text"))
        row_b, code_b = shingle_sets(batch.column("other"))
        both = overlap(row_a, code_a, row_b, code_b, n)
        either = np.bincount(row_a, minlength=n) + np.bincount(row_b, minlength=n) - both
        return pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(both), pa.array(either)],
            names=["a", "b", "both", "either"],
        )

    texts = (
        texts.select("node", "text")
        .mapInArrow(wanted, "node long, text string")
        .join(needed, "node", "left_semi")
        .dropDuplicates(["node"])
    )
    joined = pairs.join(texts.withColumnRenamed("node", "a"), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("other")), "b"
    )
    return map_arrow(
        joined.select("a", "b", "text", "other"), step, "a long, b long, both long, either long"
    )


def _ordered(one: str, two: str) -> list:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def links_of(docs: DataFrame, ranks: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(a, b): verified links that connect every two nodes that matching pairs connect."""
    members = stored(_members(_regions(docs, ranks, percent)), "members")
    degrees = members.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    texts = stored(_texts(docs, degrees.select("node")), "texts")
    images = stored(texts.select("node", "size", "image").dropDuplicates(["node"]), "images")
    linked = F.col("both") * 100 >= percent * F.col("either")
    # Rows still to be joined; the distance to the region's first pivot is from "low" to "high".
    active = stored(
        members.join(degrees, "node")
        .withColumn("label", F.col("node"))
        .withColumn("low", F.lit(0.0))
        .withColumn("high", F.lit(1.0)),
        "active",
    )
    tested, matched, links = None, None, None
    for turn in range(ROUNDS):
        # The pivot: at first the document met most often, later one (another in each
        # region) of the region's largest group of connected documents.
        groups = active.groupBy("key", "label").agg(
            F.count(F.lit(1)).alias("members"),
            F.max(
                F.struct("degree", "node", "size", "left")
                if turn == 0
                else F.struct(F.xxhash64("node", "key", F.lit(turn)), "node", "size", "left")
            ).alias("top"),
        )
        pivots = groups.groupBy("key").agg(
            (
                F.max(F.struct("top", "label"))
                if turn == 0
                else F.max(F.struct("members", "label", "top"))
            ).alias("best")
        ).select(
            "key",
            F.col("best.label").alias("own"),
            F.col("best.top.node").alias("pivot"),
            F.col("best.top.size").alias("p_size"),
            F.col("best.top.left").alias("p_left"),
        )
        if turn == 0:
            pivots = first = stored(pivots, "pivots")
        pairs = (
            active.join(pivots, "key")
            .where(
                (F.col("label") != F.col("own"))
                & may_match(F.col("size"), F.col("left"), F.col("p_size"), F.col("p_left"), percent)
            )
            .select(*_ordered("node", "pivot"))
            .distinct()
        )
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        compared = stored(_compared(pairs, images, percent), "compared")
        found = stored(_verified(compared.where("close").select("a", "b"), texts), "found")
        tried = compared.select("a", "b")
        tested = tried if tested is None else tested.unionByName(tried)
        matched = found if matched is None else matched.unionByName(found)
        links = matched.where(linked).select("a", "b")
        labels = labels_of(links, rounds=2)
        if turn == 0:
            distance = 1 - F.col("both") / F.col("either")
            far = compared.join(found, ["a", "b"], "left").select(
                F.col("a").alias("fa"), F.col("b").alias("fb"),
                F.coalesce(distance, "low").alias("least"), F.coalesce(distance, F.lit(1.0)).alias("most"),
            )
            at_pivot = F.col("node") == F.col("pivot")
            active = (
                active.join(first.select("key", "pivot"), "key")
                .join(
                    far,
                    (F.least("node", "pivot") == F.col("fa"))
                    & (F.greatest("node", "pivot") == F.col("fb")),
                    "left",
                )
                .withColumn("low", F.when(at_pivot, 0.0).otherwise(F.coalesce("least", "low")))
                .withColumn("high", F.when(at_pivot, 0.0).otherwise(F.coalesce("most", "high")))
                .select("key", "node", "size", "left", "degree", "label", "low", "high")
            )
        active = active.withColumnRenamed("label", "before").join(labels, "node", "left").select(
            "key", "node", "size", "left", "degree",
            F.coalesce("label", "before").alias("label"), "low", "high",
        )
        # Regions whose documents are all connected are done.
        open_regions = (
            active.groupBy("key")
            .agg(F.min("label").alias("low"), F.max("label").alias("high"))
            .where("low <> high")
            .select("key")
        )
        active = stored(active.join(open_regions, "key", "left_semi"), "active")
    active = active.join(images.select("node", "image"), "node")
    x, y = active.alias("x"), active.alias("y")
    radius = 1 - percent / 100 + 1e-9
    most = most_overlap(F.col("x.size"), F.col("y.size"), F.col("x.image"), F.col("y.image"))
    rest = (
        x.join(
            y,
            (F.col("x.key") == F.col("y.key"))
            & (F.col("x.node") < F.col("y.node"))
            & (F.col("x.label") != F.col("y.label"))
            & may_match(F.col("x.size"), F.col("x.left"), F.col("y.size"), F.col("y.left"), percent)
            # Triangle inequality around the region's first pivot.
            & (F.greatest(F.col("x.low") - F.col("y.high"), F.col("y.low") - F.col("x.high")) <= radius)
            # "most" only once: Spark would work it out first, for all pairs of a region.
            & ((100 + percent) * most >= percent * (F.col("x.size") + F.col("y.size"))),
        )
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        .distinct()
        .join(tested, ["a", "b"], "left_anti")
    )
    rest = stored(rest, "rest")
    found = stored(_verified(rest, texts), "found")
    return links.unionByName(found.where(linked).select("a", "b"))


def _grouped(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, node), and (node, label, least) of every node."""
    rows, ranks = _nodes(docs)
    labels = labels_of(links_of(docs, ranks, percent))
    nodes = (
        rows.where("node is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("least"))
        .join(labels, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
    )
    return rows, nodes


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows, nodes = _grouped(docs, percent)
    groups = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    named = nodes.join(groups, "label").select(F.col("node").alias("named"), "component_id")
    return rows.join(named, F.col("node") == F.col("named"), "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias(
            "component_id"
        ),
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component, the one with the smallest id, with all its columns.

    Rows without a word are components of their own and all stay. Among rows that share the
    smallest id and the same set, the first text in code point order stays.
    """
    _, nodes = _grouped(docs, percent)
    winners = (
        nodes.groupBy("label")
        .agg(F.min_by("node", F.struct(F.col("least").isNull(), "least", "node")).alias("node"),
             F.min("least").alias("least"))
        .select(F.col("node").alias("won"), F.col("least").alias("won_id"))
    )
    packed = docs.select("doc_id", "text", F.struct("*").alias("row"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, node = set_ids(*shingle_sets(batch.column("text")), batch.num_rows)
        some = pa.array(size > 0)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), int64(node), batch.column("row")], names=["doc_id", "node", "row"]
        ).filter(some)

    schema = StructType(
        [packed.schema["doc_id"], *StructType.fromDDL("node long").fields, packed.schema["row"]]
    )
    chosen = (
        map_arrow(packed.select("doc_id", "row", "text"), step, schema)
        .join(
            winners,
            (F.col("node") == F.col("won")) & F.col("doc_id").eqNullSafe(F.col("won_id")),
            "left_semi",
        )
        .groupBy("node", "doc_id")
        .agg(F.min_by("row", "row.text").alias("row"))
        .select("row.*")
    )
    return chosen.unionByName(docs.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False))))
