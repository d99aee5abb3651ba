"""Helpers the training-data operators share: tables, words, folds, Arrow passes, stored steps."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronolode.session import shared_dir

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Text bytes one numpy step works on, so that its arrays of numbers stay near the processor's
# caches; a longer text is a step of its own.
STEP_BYTES = 1 << 19
# Rows of one Arrow batch; keeps batches of long texts small on both sides.
BATCH_ROWS = 1000
# Messages of packed rows in one Arrow batch.
PACKED_AT_ONCE = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application (as --py-files would)."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


def word_count(text: Column) -> Column:
    """Words of a text as long; NULL counts as the empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a NULL id counts as the empty text."""
    return F.pmod(
        F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)
    )


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_steps(
    batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES
) -> Iterator[pa.RecordBatch]:
    """Split a batch into runs of rows of about ``limit`` bytes of text; NULL texts become empty."""
    at = batch.schema.get_field_index(column)
    text = pc.fill_null(batch.column(at).cast(pa.string()), "")
    batch = batch.set_column(at, column, text)
    sizes = pc.binary_length(text).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if start < len(sizes):
        yield batch.slice(start)


def packed(rows: pa.RecordBatch, part: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Part numbers and, for each, its rows as one compressed Arrow message."""
    order = np.argsort(part, kind="stable")
    rows, part = rows.take(pa.array(order)), part[order]
    first = np.flatnonzero(np.diff(part, prepend=-1))
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for i in range(0, len(first), PACKED_AT_ONCE):
        at = first[i : i + PACKED_AT_ONCE + 1].tolist()
        if len(at) <= PACKED_AT_ONCE:
            at.append(len(part))
        data = []
        for a, b in zip(at, at[1:]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                out.write_batch(rows.slice(a, b - a))
            data.append(sink.getvalue().to_pybytes())
        yield pa.array(part[at[:-1]], pa.int32()), pa.array(data, pa.binary())


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that ``packed`` put into the column ``rows``."""
    for batch in batches:
        for data in batch.column("rows"):
            yield from pa.ipc.open_stream(data.as_buffer())


def with_fields(df: DataFrame, columns: list[str], ddl: str) -> StructType:
    """Schema of ``columns`` of ``df`` and then the fields of ``ddl``."""
    return StructType([*(df.schema[c] for c in columns), *StructType.fromDDL(ddl).fields])


def map_arrow(
    df: DataFrame,
    step: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: StructType | str,
) -> DataFrame:
    """Apply ``step`` to runs of rows of bounded text size, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH_ROWS):
                for part in text_steps(batch.slice(i, BATCH_ROWS)):
                    out = step(part)
                    if out is not None and out.num_rows:
                        yield out

    return df.mapInArrow(run, schema)
