"""Author resolution (P10) and report defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"
NO_HASH = "N/A"


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def or_default(c: Column, default: str) -> Column:
    """An empty text counts as missing."""
    return F.coalesce(_filled(c), F.lit(default))


def stated_author(author_name: Column, author: Column) -> Column:
    """Author as the refactoring list states it; NULL when it does not.

    ``author`` is a plain name or the raw text of an object. An object without a
    name states nothing.
    """
    is_object = F.startswith(F.ltrim(author), F.lit("{"))
    named = F.when(is_object, F.get_json_object(author, "$.name")).otherwise(author)
    return F.coalesce(_filled(author_name), _filled(named))


def resolve_author(author_name: Column, author: Column, log_author: Column) -> Column:
    stated = stated_author(author_name, author)
    return F.coalesce(stated, _filled(log_author), F.lit(UNKNOWN))
