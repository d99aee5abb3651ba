"""A reader for JSON documents too large for one task: the elements of their arrays, by byte range.

A merged listing is one object, ``{"commits": [...]}``, of any size. Spark's own JSON reader
gives such a document to one task as one row. Here a file is cut into ranges of
``SPLIT_BYTES``; each range is read by its own task, which returns the elements (objects or
arrays) that open at nesting depth ``depth`` and start within its range, as raw JSON text with
their file and byte offset. Spark then parses them with ``from_json``.

Where a range starts inside a string the bytes alone cannot tell, so a first job lexes every
range from each possible start state — outside a string, inside one, inside one just after a
backslash — and keeps, per state, the state at its end and the change of depth. Chaining those
summaries, one small row per range, gives each range its true start state and depth. Only
quotes, backslashes and brackets are looked at, with a regular expression over the bytes.

An element that starts in a range and ends after it is read on by its task until it closes.
Scalars at the element depth are not elements. A file whose brackets do not balance gives the
elements it has; an element cut off by the end of the file comes back as its text up to there
(``from_json`` then gives NULL and the caller's rejects take it). Paths are file system paths
that every executor can open (a shared mount on a cluster).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Bytes of one range: what a task reads before it reaches its last element's end.
SPLIT_BYTES = 64 << 20
# Bytes read at a time when an element runs past its range.
READ_ON = 1 << 20

_OUTSIDE = re.compile(rb'["{}\[\]]')
_INSIDE = re.compile(rb'["\\]')
# Start states: (inside a string, just after a backslash in one).
STATES = [(False, False), (True, False), (True, True)]


def _scan(data: bytes, pos: int, inside: bool, escaped: bool, depth: int):
    """Walk ``data`` from ``pos``; yield (offset, byte, depth after) for brackets outside
    strings; return the state at the end as (inside, escaped, depth)."""
    n = len(data)
    if escaped:
        if pos >= n:
            return inside, escaped, depth
        pos, escaped = pos + 1, False
    while pos < n:
        if inside:
            m = _INSIDE.search(data, pos)
            if m is None:
                return True, False, depth
            if data[m.start()] == 0x22:  # closing quote
                inside, pos = False, m.end()
            elif m.end() >= n:  # a backslash at the very end
                return True, True, depth
            else:
                pos = m.end() + 1
        else:
            m = _OUTSIDE.search(data, pos)
            if m is None:
                return False, False, depth
            c = data[m.start()]
            if c == 0x22:
                inside = True
            else:
                depth += 1 if c in (0x7B, 0x5B) else -1
                yield m.start(), c, depth
            pos = m.end()
    return inside, escaped, depth


class _Walk:
    """The events of ``_scan``; ``end`` holds its end state once they are all taken."""

    def __init__(self, *args):
        self.args, self.end = args, None

    def __iter__(self):
        self.end = yield from _scan(*self.args)


def summary(data: bytes, inside: bool, escaped: bool) -> tuple[bool, bool, int]:
    """State at the end of ``data`` and its change of depth, from one start state."""
    walk = _Walk(data, 0, inside, escaped, 0)
    for _ in walk:
        pass
    return walk.end


def ranges_of(paths: list[str], split: int) -> list[tuple[str, int, int]]:
    out = []
    for path in paths:
        size = os.path.getsize(path)
        out += [(path, start, min(size, start + split)) for start in range(0, max(size, 1), split)]
    return out


def _files(path: str) -> list[str]:
    path = path.removeprefix("file:")
    if os.path.isdir(path):
        return sorted(
            os.path.join(root, f)
            for root, _, names in os.walk(path)
            for f in names
            if not f.startswith((".", "_"))
        )
    return [path]


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, inside: bool, escaped: bool, depth: int):
        self.path, self.start, self.end = path, start, end
        self.inside, self.escaped, self.depth = inside, escaped, depth


class _ElementReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.ranges = json.loads(options["ranges"])
        self.depth = int(options.get("depth", "2"))

    def partitions(self) -> list[InputPartition]:
        return [_Range(*r) for r in self.ranges]

    def read(self, part: _Range) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            f.seek(part.start)
            data = f.read(part.end - part.start)
            walk = _Walk(data, 0, part.inside, part.escaped, part.depth)
            opened = None
            for at, c, depth in walk:
                if c in (0x7B, 0x5B) and depth == self.depth + 1:
                    opened = at
                elif opened is not None and depth == self.depth:
                    yield part.path, part.start + opened, data[opened : at + 1].decode("utf-8", "replace")
                    opened = None
            if opened is None:
                return
            # The last element runs past the range: read on until it closes.
            inside, escaped, depth = walk.end
            base = part.start + opened
            text = bytearray(data[opened:])
            while True:
                more = f.read(READ_ON)
                if not more:
                    yield part.path, base, text.decode("utf-8", "replace")
                    return
                walk = _Walk(more, 0, inside, escaped, depth)
                for at, c, d in walk:
                    if d == self.depth:
                        text += more[: at + 1]
                        yield part.path, base, text.decode("utf-8", "replace")
                        return
                inside, escaped, depth = walk.end
                text += more


class JsonElements(DataSource):
    """``spark.read.format("json_elements").option("ranges", ..)``: see ``read_elements``."""

    @classmethod
    def name(cls) -> str:
        return "json_elements"

    def schema(self) -> str:
        return "file string, offset long, element string"

    def reader(self, schema) -> DataSourceReader:
        return _ElementReader(self.options)


def _summaries(spark: SparkSession, ranges: list[tuple[str, int, int]]) -> dict[tuple[str, int], list]:
    """Per range and start state: the state at its end and its change of depth (one Spark job)."""

    def lex(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path, start, end in zip(batch["path"], batch["start"], batch["end"]):
                with open(path, "rb") as f:
                    f.seek(start)
                    data = f.read(end - start)
                rows.append((path, start, json.dumps([summary(data, i, e) for i, e in STATES])))
            yield pd.DataFrame(rows, columns=["path", "start", "states"])

    table = spark.createDataFrame(ranges, "path string, start long, end long")
    table = table.repartition(max(1, min(len(ranges), spark.sparkContext.defaultParallelism * 4)))
    found = table.mapInPandas(lex, "path string, start long, states string").collect()
    return {(r.path, r.start): json.loads(r.states) for r in found}


def read_elements(
    spark: SparkSession, path: str, depth: int = 2, split: int | None = None
) -> DataFrame:
    """file, offset, element (JSON text) of every element opened at ``depth`` in the files.

    ``depth`` counts the containers around an element: 2 for ``{"commits": [ {...}, .. ]}``.
    """
    spark.dataSource.register(JsonElements)
    ranges = ranges_of(_files(path), split or SPLIT_BYTES)
    states = _summaries(spark, ranges)
    planned, state, last = [], (False, False, 0), None
    for file, start, end in ranges:
        if file != last:
            state, last = (False, False, 0), file
        inside, escaped, level = state
        planned.append((file, start, end, inside, escaped, level))
        end_inside, end_escaped, delta = states[(file, start)][STATES.index((inside, escaped))]
        state = (end_inside, end_escaped, level + delta)
    return (
        spark.read.format("json_elements")
        .option("ranges", json.dumps(planned))
        .option("depth", str(depth))
        .load()
    )


def read_listing(
    spark: SparkSession, path: str, split: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Listed commits of merged listing documents: (commits, rejects).

    Commits have project (the folder), file, offset and the listed fields; rejects are
    elements that do not parse as a commit or have no ``sha1``, with file, offset and text.
    """
    from .. import schemas
    from .readers import folder

    raw = read_elements(spark, path, 2, split)
    parsed = raw.withColumn(
        "commit", F.from_json("element", schemas.LISTED_COMMIT, {"mode": "PERMISSIVE"})
    ).withColumn("project", folder(F.col("file")))
    # An element that parses but names no commit is a reject too.
    ok = F.coalesce(F.col("commit.sha1").isNotNull(), F.lit(False))
    commits = parsed.where(ok).select("project", "file", "offset", "commit.*")
    rejects = parsed.where(~ok).select("project", "file", "offset", "element")
    return commits, rejects
