"""Time stamps and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMMITTER_FORMAT = "yyyy-MM-dd HH:mm:ss Z"


def strip(c: Column) -> Column:
    """Trim all ASCII white space, not only blanks."""
    return F.trim(c, F.lit(" \t\n\r\f\v"))


def parse_committer_time(text: Column) -> Column:
    """``2024-01-31 10:00:00 +0200`` as an instant; NULL when malformed."""
    return F.try_to_timestamp(text, F.lit(COMMITTER_FORMAT))


def parse_author_time(text: Column) -> Column:
    """ISO-8601 with offset as an instant; NULL when malformed."""
    return F.try_to_timestamp(text)


def offset_of(text: Column) -> Column:
    """The offset an instant forgets, as written at the end of the text."""
    return F.nullif(F.regexp_extract(text, r"([+-]\d{2}:?\d{2}|Z)$", 1), F.lit(""))


def half_even_seconds(micros: Column, parts: Column) -> Column:
    """``micros / parts`` in whole seconds, halves to the even neighbour; 0 without parts."""
    mean = F.rint(micros / F.lit(1e6) / parts).cast("bigint")
    return F.when(parts > 0, mean).otherwise(F.lit(0).cast("bigint"))
