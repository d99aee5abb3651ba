"""Line deduplication by an exact set-similarity join of lines.

A line is the set of its words (lower case). Lines of fewer than ``LEAST_WORDS`` distinct
words are left alone: they recur in any language. Tokens are ordered by rarity (counts of all
lines in a fixed number of counters), prefixes of the rarest tokens meet by token, the length,
positional and bitmap filters drop pairs that cannot match, Jaccard is verified on whole lines
and every line with an earlier match is removed. Earlier means a smaller (doc_id, line number),
NULL ids last. A removed line still removes its own later matches.

The bitmap filter compares 128-bit images of two token sets (a token flips one bit): their
differing bits are at most the differing tokens. Bits fill up with the size of a line, so lines
of more than ``WIDE_FROM`` tokens also have an image that widens with their size.

Lines with equal sets are one node, known by its first place. A line is first tried with a few
earlier lines of each token, those nearest by bitmap: ``NEAREST`` if the nearest is all but equal,
which settles tight groups of copies in linear work, else ``TRIED``. Lines without a match among
those are tried with the next ones, held back until then (up to ``HELD``); lines that had more are
joined with all earlier lines that pass the filters.

Rows of lines and of tokens travel packed: a task sends what it has for a part of the nodes (or
tokens) as one compressed Arrow message, and a part is sorted in the task that reads it.

Defined results: a NULL text stays NULL and has no lines; removing keeps the other lines and
their order and joins them with line feeds; a text may become empty. Rows with the same id
count as one place: of their lines with the same number and words all stay or all go. An
empty table gives no row; other columns stay whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolode.llm.arrays import Words, line_spans, sets, utf8
from chronolode.llm.common import map_arrow, packed, stored, text_steps, unpacked
from chronolode.llm.setjoin import (
    COUNTER_BITS,
    by_rank,
    counter_of,
    emit_counts,
    int64,
    may_hold,
    may_match,
    overlap,
    prefixes_of,
    rarity,
    seen,
    set_ids,
)

LEAST_WORDS = 5
PERCENT = 80
# Earlier lines a line is tried with in each token before the others are looked at: this many
# if the nearest differs in at most a third of the bits a match may differ in, else the latter.
NEAREST = 2
TRIED = 4
# Nearest lines that are tried or held back, in the same two cases.
HELD = (16, 256)
# Lines of one token that are compared lag by lag, and that a task holds at most.
SHORT_RUN = 32
LONG_RUN = 16_384
ROWS_AT_ONCE = 128
PAIRS_AT_ONCE = 1 << 16
# Rows a task packs at once: at least the first, and the second for each part up to the third.
PACKED_ROWS = (1 << 17, 1 << 9, 1 << 20)
# Rows of a part that a task holds before long runs are taken out.
PART_ROWS = 1 << 20
ROWS_OF_RUNS = 16_384
# Parts in which the counters of all tasks are added.
COUNTER_CHUNKS = 16
FAR = 1 << 20
BITS = ("bits", "bits2")
# Lines of more tokens have a wide image: 256 bits up to twice as many, 512 up to four times, ...
WIDE_FROM = 176
LAST = (1 << 63) - 1  # place of a NULL id


class Lines:
    """Lines of a batch that are long enough: row, number, byte span, token set and its id.

    With ranks the tokens of a line are ordered by rarity, else by fingerprint.
    """

    def __init__(self, text: pa.Array, ranks: np.ndarray | None = None):
        words = Words(text, lower=True)
        start, end, row = words.lines()
        first = np.zeros(words.rows + 1, np.int64)
        first[1:] = np.cumsum(np.bincount(row, minlength=words.rows))
        # A line that begins where the next row does comes before it and is empty.
        bound = np.searchsorted(words.start, start)
        line = np.repeat(np.arange(len(start)), np.diff(bound, append=len(words.start)))
        of, code = sets(line, words.hash, None if ranks is None else by_rank(words.hash, ranks))
        size, node = set_ids(of, code, len(start))
        good = size >= LEAST_WORDS
        number = np.cumsum(good) - 1
        keep = good[of]
        self.data = words.data
        self.row, self.number = row[good], (np.arange(len(row)) - first[row])[good]
        self.start, self.end = start[good], end[good]
        self.size, self.node = size[good], node[good]
        self.of, self.code = number[of[keep]], code[keep]

    def bitmap(self) -> np.ndarray:
        """Bit by bit, whether an odd number of tokens falls on it; does not fill up.

        Two columns of 64 bits.
        """
        out = np.zeros((len(self.size), 2), np.uint64)
        half = (self.code >> np.uint64(6) & np.uint64(1)).astype(np.int64)
        np.bitwise_xor.at(
            out.reshape(-1), 2 * self.of + half, np.uint64(1) << (self.code & np.uint64(63))
        )
        return out

    def wide(self, some: np.ndarray) -> list[bytes | None]:
        """The wide images of the lines of a mask, as bytes; None for a line without one."""
        out: list[bytes | None] = [None] * int(some.sum())
        place = np.cumsum(some) - 1
        level = np.where(some, wide_level(self.size), 0)
        for k in np.unique(level[level > 0]).tolist():
            at = np.flatnonzero(level == k)
            keep = level[self.of] == k
            bit = (self.code[keep] & np.uint64((128 << k) - 1)).astype(np.int64)
            image = np.zeros((len(at), 2 << k), np.uint64)
            row = np.searchsorted(at, self.of[keep])
            np.bitwise_xor.at(
                image.reshape(-1), row * (2 << k) + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64)
            )
            for i, line in zip(place[at].tolist(), image):
                out[i] = line.tobytes()
        return out

    def fresh(self, met: dict[int, tuple[int, int]], doc: np.ndarray) -> np.ndarray:
        """Which lines have an earlier place than all of their node that the task has seen."""
        out = np.zeros(len(self.size), bool)
        places = zip(doc[self.row].tolist(), self.number.tolist())
        for i, (name, place) in enumerate(zip(self.node.tolist(), places)):
            known = met.get(name)
            if known is None or place < known:
                met[name] = place
                out[i] = True
        return out


def wide_level(size: np.ndarray) -> np.ndarray:
    """Doublings of 128 bits that the wide image of lines of these sizes has; 0: it has none."""
    return np.ceil(np.log2(np.maximum(size, WIDE_FROM) / WIDE_FROM)).astype(np.int64)


def _images(wide: np.ndarray, level: int, to: int) -> np.ndarray:
    """Wide images of one level as rows of words, folded to a lower level."""
    out = np.frombuffer(b"".join(wide), np.uint64).reshape(len(wide), 2 << level)
    while out.shape[1] > 2 << to:
        half = out.shape[1] // 2
        out = out[:, :half] ^ out[:, half:]
    return out


def _place(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text"
    )


def _parts(docs: DataFrame) -> int:
    """Parts that lines and tokens are dealt to: as many as the session's shuffles have."""
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _packed_rows(parts: int) -> int:
    least, each, most = PACKED_ROWS
    return min(max(least, each * parts), most)


def _first_places(
    node: np.ndarray, doc: np.ndarray, line: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have the first place of each node, and rows that have a later one than that."""
    order = np.lexsort((line, doc, node))
    node, doc, line = node[order], doc[order], line[order]
    first = np.ones(len(order), bool)
    first[1:] = node[1:] != node[:-1]
    of = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[first], order[(doc != doc[of]) | (line != line[of])]


def _nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """First place of each node, places of its other lines, and the rarity ranks of all tokens.

    A task sends a node once for the rows it packs; what it has of later places are copies for sure.
    """
    parts = _parts(docs)
    at_once = _packed_rows(parts)
    columns = ["node", "doc", "line"]

    def split(held: list[list[np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        rows = [np.concatenate(c) for c in zip(*held)]
        first, copies = _first_places(*rows)
        return [c[first] for c in rows], [c[copies] for c in rows]

    def out(of: dict[str, pa.Array]) -> pa.RecordBatch:
        n = len(next(iter(of.values())))
        return pa.RecordBatch.from_arrays([of.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    schema = pa.schema(
        [("part", pa.int32()), ("chunk", pa.int32()), ("rows", pa.binary()), ("doc", pa.int64()), ("line", pa.int32())]
    )

    def emit(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        first, copies = split(held)
        part = (first[0].view(np.uint64) % np.uint64(parts)).astype(np.int32)
        rows = pa.RecordBatch.from_arrays([pa.array(c) for c in first], names=columns)
        yield from (out({"part": at, "rows": data}) for at, data in packed(rows, part))
        yield out({"doc": pa.array(copies[1]), "line": pa.array(copies[2])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        held, size = [], 0
        for batch in batches:
            for part in text_steps(batch):
                lines = Lines(part.column("text"))
                total += np.bincount(counter_of(lines.code), minlength=len(total))
                doc = part.column("doc").to_numpy()[lines.row]
                held.append([lines.node.view(np.int64), doc, lines.number.astype(np.int32)])
                size += len(doc)
                if size >= at_once:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)
        yield out({"chunk": pa.array(range(COUNTER_CHUNKS), pa.int32()),
                   "rows": pa.array([c.tobytes() for c in np.split(total, COUNTER_CHUNKS)], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((COUNTER_CHUNKS, (1 << COUNTER_BITS) // COUNTER_CHUNKS), np.int64)
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("rows")):
                total[chunk] += np.frombuffer(data.as_buffer(), np.int64)
        for at, n in emit_counts(total.reshape(-1)):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["counter", "n"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in rows.columns] for rows in unpacked(batches)]
        if held:
            first, copies = split(held)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in first], names=columns)
            none = pa.nulls(len(copies[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([none, *(pa.array(c) for c in copies[1:])], names=columns)

    both = stored(
        _place(docs).mapInArrow(run, "part int, chunk int, rows binary, doc long, line int"), "lines"
    )
    ranks = rarity(
        both.where("chunk is not null")
        .select("chunk", "rows")
        .repartitionById(COUNTER_CHUNKS, F.col("chunk"))
        .mapInArrow(added, "counter int, n long")
    )
    nodes = stored(
        both.where("part is not null")
        .select("part", "rows")
        .repartitionById(parts, F.col("part"))
        .mapInArrow(whole, "node long, doc long, line int"),
        "nodes",
    )
    copies = both.where("line is not null").select("doc", "line")
    copies = copies.union(nodes.where("node is null").select("doc", "line"))
    return nodes.where("node is not null"), copies, ranks


def _prefix_rows(
    batches: Iterator[pa.RecordBatch], ranks: np.ndarray, percent: int
) -> Iterator[pa.RecordBatch]:
    """Prefix tokens of each node a task sees first (or at an earlier place than before).

    A key is half of a token's fingerprint: tokens that share one only meet without need.
    """
    met: dict[int, tuple[int, int]] = {}
    for batch in batches:
        for part in text_steps(batch):
            lines = Lines(part.column("text"), ranks)
            docs_of = part.column("doc").to_numpy()
            fresh = lines.fresh(met, docs_of)
            bits = lines.bitmap()[fresh]
            keep = fresh[lines.of]
            number = np.cumsum(fresh) - 1
            size = lines.size[fresh]
            of, code, place = prefixes_of(number[lines.of[keep]], lines.code[keep], size, percent)
            wide = lines.wide(fresh)
            wide = pa.array(wide, pa.binary()).take(pa.array(of)) if any(wide) else pa.nulls(len(of), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array((code & np.uint64(0xFFFFFFFF)).astype(np.uint32)), int64(lines.node[fresh][of]),
                 pa.array(size[of].astype(np.int32)), pa.array((size[of] - place).astype(np.int32)),
                 int64(np.ascontiguousarray(bits[of, 0])), int64(np.ascontiguousarray(bits[of, 1])),
                 pa.array(docs_of[lines.row[fresh]][of]), pa.array(lines.number[fresh][of].astype(np.int32)), wide],
                names=["key", "node", "size", "left", "bits", "bits2", "doc", "line", "wide"],
            )


def _tokens(docs: DataFrame, ranks: np.ndarray, percent: int) -> DataFrame:
    """(part, rows): packed prefix tokens, one Arrow message for the tokens of a part."""
    parts = _parts(docs)
    at_once = _packed_rows(parts)

    def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()
        for batch in rows:
            part = (batch.column("key").to_numpy() % np.uint32(parts)).astype(np.int32)
            for at, data in packed(batch, part):
                yield pa.RecordBatch.from_arrays([at, data], names=["part", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows in _prefix_rows(batches, ranks, percent):
            held.append(rows)
            size += rows.num_rows
            if size >= at_once:
                yield from emit(held)
                held, size = [], 0
        if size:
            yield from emit(held)

    return _place(docs).mapInArrow(run, "part int, rows binary")


def _tokens_of(docs: DataFrame, ranks: np.ndarray, percent: int, keys: DataFrame) -> DataFrame:
    """(key, node, size, left, bits, bits2, doc, line): prefix tokens that may have one of the keys."""
    bits = may_hold(keys.select(F.col("key").alias("node")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _prefix_rows(batches, ranks, percent):
            key = rows.column("key").to_numpy().astype(np.int64)
            at = np.flatnonzero(seen(key, bits))
            names = ["node", "size", "left", "bits", "bits2", "doc", "line"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[at]), *(rows.column(c).take(pa.array(at)) for c in names)], names=["key", *names]
            )

    return _place(docs).mapInArrow(
        run, "key long, node long, size int, left int, bits long, bits2 long, doc long, line int"
    )


def _distance(a: dict, b: dict) -> np.ndarray:
    """Differing bits of row pairs (arrays that broadcast), over all columns of bits given."""
    out = 0
    for c in BITS:
        if c in a:
            out = out + np.bitwise_count((a[c] ^ b[c]).view(np.uint64)).astype(np.int64)
    return out


def _passes(a: dict, b: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which row pairs (arrays that broadcast) pass all filters, and their bit distances."""
    m, n = a["size"], b["size"]
    distance = _distance(a, b)
    both = m + n
    good = (
        (100 * np.minimum(m, n) >= percent * np.maximum(m, n))
        & ((100 + percent) * distance <= (100 - percent) * both)
        & (np.minimum(a["left"], b["left"]) * (100 + percent) >= percent * both)
        & (a["node"] != b["node"])
    )
    return good, distance


def _near_enough(
    rows: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of row pairs that pass by size and place, those of two nodes whose images pass too."""
    some = rows["node"][x] != rows["node"][y]
    x, y = x[some], y[some]
    most = (100 - percent) * (rows["size"][x] + rows["size"][y])
    distance = _distance({c: rows[c][x] for c in BITS if c in rows}, {c: rows[c][y] for c in BITS if c in rows})
    some = (100 + percent) * distance <= most
    x, y, distance, most = x[some], y[some], distance[some], most[some]
    if "wide" in rows and len(x):
        a, b = wide_level(rows["size"][x]), wide_level(rows["size"][y])
        for i, j in {(i, j) for i, j in zip(a.tolist(), b.tolist()) if i and j}:
            at = np.flatnonzero((a == i) & (b == j))
            both = [_images(rows["wide"][v[at]], k, min(i, j)) for v, k in ((x, i), (y, j))]
            distance[at] = np.bitwise_count(both[0] ^ both[1]).sum(1, dtype=np.int64)
        some = (100 + percent) * distance <= most
        x, y, distance = x[some], y[some], distance[some]
    return x, y, distance


def _nearest(
    x: np.ndarray, y: np.ndarray, distance: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs ordered by x and distance, and how many of the same x come before each."""
    order = np.lexsort((y, distance, x))
    x, y, distance = x[order], y[order], distance[order]
    return x, y, distance, np.arange(len(x)) - np.searchsorted(x, x)


def _limits(
    size: np.ndarray, distance: np.ndarray, rank: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """How many nearest lines each x (of these sizes) is tried with, and how many with those held back."""
    best = distance[np.arange(len(rank)) - rank]
    close = 3 * (100 + percent) * best <= 2 * (100 - percent) * size.astype(np.int64)
    tried = np.where(close, NEAREST, max(NEAREST, TRIED))
    return tried, np.maximum(tried, np.where(close, *HELD))


def _pairs_in_runs(
    rows: dict[str, np.ndarray], percent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs (later, earlier) of equal keys that pass all filters, and their bit distance.

    Rows are ordered by key and place. Short runs are compared lag by lag, all at once. In
    longer ones some rows at a time are compared with smaller ones whose size is near enough,
    and of many that pass one more than is tried or held back is kept for each.
    """
    key, size = rows["key"], rows["size"].astype(np.int32)
    # Largest size of a partner: by the length filter, and by the positional one.
    most = np.minimum(
        100 * rows["size"] // percent, (100 + percent) * rows["left"] // percent - rows["size"]
    ).astype(np.int32)
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    place = np.arange(len(key)) - start
    bounds = np.append(np.flatnonzero(first), len(key))
    length = np.diff(bounds)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    x = np.flatnonzero(np.repeat(length <= SHORT_RUN, length) & (place > 0))
    for lag in range(1, SHORT_RUN):
        x = x[place[x] >= lag]
        if not len(x):
            break
        y = x - lag
        good = (size[y] <= most[x]) & (size[x] <= most[y])
        found.append(_near_enough(rows, x[good], y[good], percent))
    met, waiting, held, limit = [], 0, 0, PAIRS_AT_ONCE
    for a, n in zip(bounds[:-1][length > SHORT_RUN], length[length > SHORT_RUN]):
        order = a + np.argsort(size[a : a + n], kind="stable")
        # Of a pair, the one that is first in this order must reach as far as its own size at least.
        at_y = np.flatnonzero(most[order] >= size[order])
        y_all = order[at_y]
        size_y, most_y = size[y_all], most[y_all]
        for i in range(0, n, ROWS_AT_ONCE):
            x = order[i : i + ROWS_AT_ONCE]
            low = np.searchsorted(size_y, percent * int(size[x[0]]) // 100)
            high = np.searchsorted(at_y, i + len(x))
            if low >= high:
                continue
            good = most_y[low:high] >= size[x][:, None]
            good &= size_y[low:high] <= most[x][:, None]
            good &= at_y[low:high] < np.arange(i, i + len(x))[:, None]
            at, pick = np.divmod(np.flatnonzero(good), high - low)
            met.append((x[at], y_all[low + pick]))
            waiting += len(at)
            if waiting < PAIRS_AT_ONCE:
                continue
            found.append(_met(rows, met, percent))
            held += len(found[-1][0])
            met, waiting = [], 0
            if held > limit:
                found = [_kept(rows, found, percent)]
                held = len(found[0][0])
                limit = max(PAIRS_AT_ONCE, 2 * held)
    if waiting:
        found.append(_met(rows, met, percent))
    return tuple(np.concatenate(c) for c in zip(*found))


def _met(
    rows: dict[str, np.ndarray], pairs: list[tuple[np.ndarray, np.ndarray]], percent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of row pairs in any order, (later, earlier, distance) of those that are near enough."""
    x, y = (np.concatenate(c) for c in zip(*pairs))
    return _near_enough(rows, np.maximum(x, y), np.minimum(x, y), percent)


def _kept(
    rows: dict[str, np.ndarray], pairs: list[tuple[np.ndarray, ...]], percent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of row pairs with their distances, one more for each later row than is tried or held back."""
    x, y, distance, rank = _nearest(*(np.concatenate(c) for c in zip(*pairs)))
    keep = rank <= _limits(rows["size"][x], distance, rank, percent)[1]
    return x[keep], y[keep], distance[keep]


def _first_rows(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The first place of each node in each key, ordered by key and place; keys are in order."""
    key = rows["key"]
    at = np.lexsort((rows["line"], rows["doc"], key))
    node, key = rows["node"][at], key[at]
    order = np.lexsort((node, key))
    first = np.ones(len(order), bool)
    first[1:] = (node[order][1:] != node[order][:-1]) | (key[order][1:] != key[order][:-1])
    at = at[np.sort(order[first])]
    return {c: v[at] for c, v in rows.items()}


def _candidates(tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs (later, earlier) to try, or ``held`` back; with ``earlier`` NULL, rows of (later) with more.

    One shuffle by part of the tokens. A line is paired, in each of its tokens, with the nearest earlier
    lines by bit distance (each task sends a node with its earliest place there, so the place of
    a node's first line is always among its rows, and its other rows of the key are dropped); if
    more pass the filters, its row of the token without ``earlier`` says so. Of a token with more
    than ``LONG_RUN`` lines none is held: each of its lines is paired with one of them, and all
    are said to have more.
    """
    columns = ["key", "node", "size", "left", *BITS, "doc", "line"]
    details = ["key", "size", "left", *BITS, "doc", "line"]
    out = pa.schema([(c, pa.int64()) for c in ("later", "earlier", "held", *details)])

    def emit(later: np.ndarray, earlier: np.ndarray, held: int) -> pa.RecordBatch:
        order = np.lexsort((earlier, later))
        later, earlier = later[order], earlier[order]
        new = np.ones(len(order), bool)
        new[1:] = (later[1:] != later[:-1]) | (earlier[1:] != earlier[:-1])
        later, earlier = later[new], earlier[new]
        none = pa.nulls(len(later), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(later), pa.array(earlier), pa.array(np.full(len(later), held)), *[none] * len(details)],
            schema=out,
        )

    def had_more(rows: dict[str, np.ndarray], x: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(x), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(rows["node"][x]), none, none, *(pa.array(rows[c][x]) for c in details)], schema=out
        )

    def whole(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = _first_rows(rows)
        x, y, distance, rank = _nearest(*_pairs_in_runs(rows, percent))
        tried, most = _limits(rows["size"][x], distance, rank, percent)
        node, now = rows["node"], rank < tried
        later = ~now & (rank < most)
        yield emit(node[x[now]], node[y[now]], 0)
        yield emit(node[x[later]], node[y[later]], 1)
        yield had_more(rows, np.unique(x[rank >= most]))

    def long_run(rows: dict[str, np.ndarray], leader: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = rows["node"] != leader["node"][0]
        node, m, n = rows["node"][x], rows["size"][x], int(leader["size"][0])
        distance = _distance({c: rows[c][x] for c in BITS}, leader)
        near = (100 * np.minimum(m, n) >= percent * np.maximum(m, n)) & (
            (100 + percent) * distance <= (100 - percent) * (m + n)
        )
        yield emit(node[near], np.full(int(near.sum()), leader["node"][0]), 0)
        yield had_more(rows, np.arange(len(rows["node"])))

    def short_runs(
        rows: dict[str, np.ndarray], leaders: dict[int, dict[str, np.ndarray]]
    ) -> Iterator[pa.RecordBatch | dict[str, np.ndarray]]:
        """Pairs of the long runs, and last the rows of all other tokens, ordered by key."""
        order = np.sort(rows["key"].astype(np.uint64) << np.uint64(32) | np.arange(len(rows["key"]), dtype=np.uint64))
        key, order = (order >> np.uint64(32)).astype(np.int64), (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        length = np.diff(first, append=len(key))
        long = length >= LONG_RUN
        if leaders:
            long |= np.isin(key[first], list(leaders))
        for at, n in zip(first[long], length[long]):
            run = {c: v[order[at : at + n]] for c, v in rows.items()}
            leader = leaders.setdefault(int(key[at]), {c: v[:1] for c, v in run.items()})
            yield from long_run(run, leader)
        order = order[np.repeat(~long, length)]
        yield {c: v[order] for c, v in rows.items()}

    def joined(held: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        return {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, limit, leaders = [], 0, PART_ROWS, {}
        for batch in unpacked(batches):
            rows = {c: batch.column(c).to_numpy().astype(np.int64, copy=False) for c in columns}
            rows["wide"] = batch.column("wide").to_numpy(zero_copy_only=False)
            held.append(rows)
            size += batch.num_rows
            if size >= limit:
                *pairs, rows = short_runs(joined(held), leaders)
                yield from pairs
                held, size = [rows], len(rows["key"])
                limit = max(limit, 2 * size)
        if not held:
            return
        *pairs, rows = short_runs(joined(held), leaders)
        yield from pairs
        key = rows["key"]
        alone = np.ones(len(key) + 1, bool)
        alone[1:-1] = key[1:] != key[:-1]
        at = ~(alone[1:] & alone[:-1])  # a key of one row gives no pair
        rows = {c: v[at] for c, v in rows.items()}
        key = rows["key"]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        start = 0
        while start < len(key):
            # Some whole tokens at a time.
            next_ = np.searchsorted(first, start + ROWS_OF_RUNS)
            end = int(first[next_]) if next_ < len(first) else len(key)
            yield from whole({c: v[start:end] for c, v in rows.items()})
            start = end

    return tokens.repartitionById(_parts(tokens), F.col("part")).mapInArrow(
        run, ", ".join(f"{c} long" for c in out.names)
    )


def _filters(x: str, y: str, percent: int):
    """Length, positional and bitmap filters of two members."""
    size_x, size_y = F.col(f"{x}.size"), F.col(f"{y}.size")
    differ = sum(F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in BITS)
    return may_match(size_x, F.col(f"{x}.left"), size_y, F.col(f"{y}.left"), percent) & (
        (100 + percent) * differ <= (100 - percent) * (size_x + size_y)
    )


# Places are numbered so that neighbouring ones differ; the numbers of others may be equal.
PLACE_DOCS, PLACE_STEP = 1 << 40, 1009


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, doc, line, text): the text of each of the needed (node, doc, line).

    Only lines whose place may be needed are taken apart; the node tells those that are.
    """
    bits = may_hold(
        needed.select((F.pmod("doc", F.lit(PLACE_DOCS)) * PLACE_STEP + F.col("line")).alias("node"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for part in text_steps(batch):
                data, offsets = utf8(part.column("text"))
                start, end, row = line_spans(data, offsets)
                number = np.arange(len(row)) - np.searchsorted(row, row)
                place = part.column("doc").to_numpy()[row] % PLACE_DOCS * PLACE_STEP + number
                maybe = np.flatnonzero(seen(place, bits))
                data = data.tobytes()
                texts = [data[a:b].decode("utf-8") for a, b in zip(start[maybe], end[maybe])]
                texts = pa.array(texts, pa.string())
                lines = Lines(texts)
                names = lines.node.tolist()
                at = np.flatnonzero(np.array([name not in met for name in names], bool))
                met.update(names)
                yield pa.RecordBatch.from_arrays(
                    [int64(lines.node[at]), texts.take(pa.array(lines.row[at]))], names=["node", "text"]
                )

    return (
        _place(docs)
        .mapInArrow(run, "node long, text string")
        .join(needed, "node")
        .dropDuplicates(["node"])
    )


def _matching(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """(later, earlier, node, doc, line, same): whether the Jaccard of two whole lines reaches the threshold.

    The node is that of the two whose first place, (doc, line), is later.
    """
    pairs = stored(pairs, "pairs")
    # Stored, so that its size is known and a small one is not joined by a shuffle of all lines.
    nodes = stored(
        pairs.select(F.col("later").alias("node")).union(pairs.select("earlier")).distinct(), "needed"
    )
    needed = stored(firsts.join(nodes, "node", "left_semi").select("node", "doc", "line"), "needed")
    texts = stored(_texts(docs, needed).select("node", "doc", "line", "text"), "texts")
    names = ["later", "earlier", "node", "doc", "line"]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        a, b = Words(batch.column("text"), lower=True), Words(batch.column("other"), lower=True)
        (row_a, code_a), (row_b, code_b) = sets(a.row, a.hash), sets(b.row, b.hash)
        both = overlap(row_a, code_a, row_b, code_b, n)
        either = np.bincount(row_a, minlength=n) + np.bincount(row_b, minlength=n) - both
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array(100 * both >= percent * either)], names=[*names, "same"]
        )

    first = F.struct("node", "doc", "line")
    joined = pairs.join(texts.select(F.col("node").alias("later"), "text", first.alias("a")), "later").join(
        texts.select(F.col("node").alias("earlier"), F.col("text").alias("other"), first.alias("b")), "earlier"
    )
    place_a, place_b = (F.struct(f"{x}.doc", f"{x}.line") for x in "ab")
    of = F.when(place_a > place_b, F.col("a")).otherwise(F.col("b"))
    return map_arrow(
        joined.select("later", "earlier", of.alias("of"), "text", "other").select(
            "later", "earlier", "of.*", "text", "other"
        ),
        step,
        "later long, earlier long, node long, doc long, line int, same boolean",
    )


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc, line) of every line to remove; a NULL id is the largest long."""
    return _removed(docs, percent).distinct()


def _removed(docs: DataFrame, percent: int) -> DataFrame:
    """As ``removed_lines``, with rows for each line of that number that goes if an id recurs."""
    firsts, copies, ranks = _nodes(docs)
    candidates = stored(_candidates(_tokens(docs, ranks, percent), percent), "candidates")
    pairs = candidates.where("held = 0").select("later", "earlier").distinct()
    # The earliest place of a node in the whole corpus decides which of two lines is later.
    first = stored(_matching(pairs, docs, firsts, percent), "pairs")
    matched = stored(_later(first), "matched")
    held = stored(
        candidates.where("held = 1")
        .select("later", "earlier")
        .join(matched, F.col("later") == F.col("node"), "left_anti")
        .distinct()
        .join(first.select("later", "earlier"), ["later", "earlier"], "left_anti"),
        "held",
    )
    if not held.isEmpty():
        second = stored(_matching(held, docs, firsts, percent), "pairs")
        first = first.union(second)
        matched = stored(matched.union(_later(second)).distinct(), "matched")
    # Lines with more candidates than were tried, and no match among those.
    more = stored(
        candidates.where("earlier is null")
        .drop("earlier", "held")
        .withColumnRenamed("later", "node")
        .join(matched, "node", "left_anti")
        .distinct(),
        "more",
    )
    if not more.isEmpty():
        # Only these rows meet the others of their tokens; no token is brought in whole.
        rest = (
            _tokens_of(docs, ranks, percent, more).alias("y").join(
                more.alias("x"),
                (F.col("x.key") == F.col("y.key"))
                & (F.col("x.node") != F.col("y.node"))
                & (F.struct("y.doc", F.col("y.line").cast("long")) < F.struct("x.doc", "x.line"))
                & _filters("x", "y", percent),
            )
            .select(F.col("x.node").alias("later"), F.col("y.node").alias("earlier"))
            .distinct()
            .join(first.select("later", "earlier"), ["later", "earlier"], "left_anti")
        )
        again = stored(_matching(rest, docs, firsts, percent), "pairs")
        matched = matched.union(_later(again)).distinct()
    return copies.union(matched.select("doc", "line"))


def _later(matches: DataFrame) -> DataFrame:
    """(node, doc, line): of each matching pair the one whose first place is later."""
    return matches.where("same").select("node", "doc", "line").distinct()


def line_report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per id: lines, lines removed, and the numbers of the removed lines."""
    gone = (
        _removed(docs, percent)
        .groupBy("doc")
        .agg(F.array_sort(F.collect_set("line")).alias("removed"))
    )
    # Bytes without line feeds are told by a plain search, several times faster than a pattern.
    feeds = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    lines = F.when(F.col("text").isNull(), 0).otherwise(feeds + 1)
    return (
        docs.select("doc_id", lines.cast("long").alias("n_lines"))
        .join(gone, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col("doc"), "left")
        .select(
            "doc_id",
            "n_lines",
            F.coalesce(F.size("removed").cast("long"), F.lit(0)).alias("n_removed"),
            F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        )
    )


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All rows and columns, texts without the removed lines."""
    gone = (
        _removed(docs, percent)
        .groupBy("doc")
        .agg(F.collect_set("line").alias("removed"))
        .select(F.col("doc").alias("gone_doc"), "removed")
    )
    packed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        F.struct("*").alias("row"),
    ).join(gone, F.col("doc") == F.col("gone_doc"), "left")
    kept = F.array_join(
        F.filter(
            F.split(F.col("row.text"), "\n", -1),
            lambda _, i: ~F.array_contains(F.col("removed"), i),
        ),
        "\n",
    )
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(kept)
    return packed.select(
        *[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    )
