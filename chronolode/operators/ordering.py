"""Positions inside a large ordered group without putting the group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_row_index(
    df: DataFrame,
    by: Sequence[str],
    pos: str,
    name: str,
    ties: Sequence[str] = (),
    block_bits: int = 16,
) -> DataFrame:
    """Zero-based position of each row in its group, ordered by the integer ``pos``.

    A plain ``row_number`` over the group would sort a whole project in one task.
    Here the rows are numbered inside blocks of ``2**block_bits`` positions, which
    spread over all tasks, and the only window over a whole group is a running sum
    of one row per block. ``pos`` should number source rows, so that gaps come only
    from filtering; other values stay right but give more blocks.
    """
    keys = [*by, "_block"]
    blocked = df.withColumn("_block", F.shiftright(F.col(pos).cast("bigint"), block_bits))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys).orderBy(pos, *ties)
    return (
        blocked.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(offsets, keys)
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_block", "_inside", "_before")
    )
