"""Project names, repository URLs and commit hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Host of the project URLs, and the owner of names without one.
HOST = "https://github.com"
DEFAULT_OWNER = "apache"


def project_field(row: Column) -> Column:
    """Second comma field of a whole row; NULL when the row has only one."""
    return F.get(F.split(row, ",", 3), F.lit(1))


def parse_owner_repo(project: Column, default_owner: str | None = None) -> Column:
    """``owner_name`` as struct(owner, name); NULL unless there are exactly two parts.

    A name without ``_`` takes ``default_owner`` when one is given.
    """
    parts = F.split(project, "_", 3)
    two = F.struct(F.get(parts, F.lit(0)).alias("owner"), F.get(parts, F.lit(1)).alias("name"))
    parsed = F.when(F.size(parts) == 2, two)
    if default_owner is not None:
        alone = F.struct(F.lit(default_owner).alias("owner"), project.alias("name"))
        parsed = parsed.when(F.size(parts) == 1, alone)
    return parsed


def repo_url(project: Column, default_owner: str = DEFAULT_OWNER) -> Column:
    """URL of a project name; NULL for a name that cannot be parsed."""
    at = parse_owner_repo(project, default_owner)
    return F.concat(F.lit(f"{HOST}/"), at["owner"], F.lit("/"), at["name"])


def short_hash(sha: Column) -> Column:
    return F.substring(sha, 1, 8)
