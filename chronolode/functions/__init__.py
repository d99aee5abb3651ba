"""Row-level rules as column expressions; all of them run inside the JVM."""

from .authors import or_default, resolve_author, stated_author
from .diffs import diff_content, lines_added, lines_deleted
from .languages import PROGRAMMING_LANGUAGES, is_programming_language
from .names import parse_owner_repo, project_field, repo_url, short_hash
from .times import half_even_seconds, offset_of, parse_author_time, parse_committer_time, strip

__all__ = [
    "PROGRAMMING_LANGUAGES",
    "diff_content",
    "half_even_seconds",
    "is_programming_language",
    "lines_added",
    "lines_deleted",
    "offset_of",
    "or_default",
    "parse_author_time",
    "parse_committer_time",
    "parse_owner_repo",
    "project_field",
    "repo_url",
    "resolve_author",
    "short_hash",
    "stated_author",
    "strip",
]
