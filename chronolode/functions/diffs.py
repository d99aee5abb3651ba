"""Line counts of unified diff text (F1, F2).

A line counts as added when it starts with one ``+`` but not with three, as deleted
likewise for ``-``. Carriage returns count for nothing, wherever they stand, and only a
line feed ends a line. One regular expression says all that, so no array of lines is
built: ``m`` anchors at line starts, ``d`` leaves ``\\n`` as the only line end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _marked(diff: Column, mark: str) -> Column:
    start = rf"(?dm)^\r*+[{mark}](?!\r*+[{mark}]\r*+[{mark}])"
    return F.coalesce(F.regexp_count(diff, F.lit(start)), F.lit(0)).cast("bigint")


def lines_added(diff: Column) -> Column:
    return _marked(diff, "+")


def lines_deleted(diff: Column) -> Column:
    return _marked(diff, "-")


def diff_content(diff: Column) -> Column:
    """The diff text, absent when empty."""
    return F.nullif(diff, F.lit(""))
