"""Fixed schemas as DDL texts. No reader infers anything."""

MEASURES = "_c0 string"

# Commit log as exported: dates are still the texts the log printed.
COMMIT_LOG = (
    "project string, sha string, pos bigint, parents array<string>, author_name string, "
    "author_date string, committer_date string, message string, on_head boolean"
)

REFACTORING = "struct<type: string>"
# ``author`` may be a text or an object; as a string column an object keeps its raw JSON.
LISTED_COMMIT = (
    f"struct<sha1: string, authorName: string, author: string, refactorings: array<{REFACTORING}>>"
)
CHUNK_FILE = f"commits array<{LISTED_COMMIT}>, _corrupt_record string"

REFACTORING_COMMITS = (
    "project string, sha string, authorName string, author string, "
    f"refactorings array<{REFACTORING}>"
)

FILE_CHANGES = (
    "project string, sha string, pos bigint, filename string, change_type string, diff string"
)

LOC_REPORTS = (
    "project string, sha string, status string, language string, n_lines bigint"
)
LOC_REPORT_BODY = "array<struct<Name: string, Lines: bigint>>"

ISSUE_PAGES = "owner string, repo string, page int, status int, issues array<string>"
ISSUE_PROBE = "owner string, repo string, status int, n_items int"
