"""DuckDB SQL for the registered queries, written from the rules and not from the plans:
sorted gaps, ranked rows and split lines instead of the shortcuts the operators take."""

from __future__ import annotations


def _project(key: str) -> str:
    return f"CASE WHEN {key} % 3 = 0 THEN 'p0' ELSE 'p' || CAST(1 + {key} % 24 AS VARCHAR) END"


def _sha(key: str) -> str:
    return f"md5(CAST({key} AS VARCHAR))"


_STEP = "(CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 24 END)"

_VIEWS = {
    "commits": f"""
        SELECT {_project("o_orderkey")} AS project, {_sha("o_orderkey")} AS sha,
               o_orderkey AS pos,
               CASE WHEN o_orderkey >= {_STEP} THEN {_sha(f"o_orderkey - {_STEP}")} END AS parent,
               CASE WHEN o_custkey % 17 <> 0
                    THEN 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS log_author,
               strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+0'
                   || CAST(o_orderkey % 5 AS VARCHAR) || ':00' AS author_date,
               CAST(epoch(o_orderdate) AS BIGINT) - 3600 * (o_orderkey % 5) AS secs,
               '+0' || CAST(o_orderkey % 5 AS VARCHAR) || ':00' AS tz,
               o_orderpriority AS message, o_orderstatus <> 'P' AS on_head
        FROM orders""",
    "listed": f"""
        SELECT {_project("l_orderkey")} AS project, {_sha("l_orderkey")} AS sha,
               CASE l_suppkey % 5 WHEN 0 THEN 'Supplier#' || CAST(l_suppkey AS VARCHAR)
                    WHEN 2 THEN '' END AS authorName,
               CASE l_suppkey % 5 WHEN 1 THEN '{{"name":"Dev ' || CAST(l_suppkey AS VARCHAR) || '"}}'
                    WHEN 2 THEN 'Plain ' || CAST(l_suppkey AS VARCHAR)
                    WHEN 3 THEN '{{"x":1}}' END AS author,
               CASE l_suppkey % 5 WHEN 0 THEN 'Supplier#' || CAST(l_suppkey AS VARCHAR)
                    WHEN 1 THEN 'Dev ' || CAST(l_suppkey AS VARCHAR)
                    WHEN 2 THEN 'Plain ' || CAST(l_suppkey AS VARCHAR) END AS stated,
               CASE WHEN l_discount <> 0 THEN l_returnflag || l_linestatus END AS type,
               CASE WHEN l_linenumber = 4 THEN 0 ELSE l_linenumber % 4 END AS n_refactorings,
               l_returnflag, l_linestatus
        FROM lineitem""",
    "refactorings": """
        SELECT project, sha, type FROM (
            SELECT project, sha, type, unnest(range(n_refactorings)) AS i FROM listed)""",
    "reports": f"""
        SELECT {_project("l_orderkey")} AS project, {_sha("l_orderkey")} AS sha,
               CASE l_orderkey % 50 WHEN 7 THEN 'tool_failed' WHEN 8 THEN 'checkout_failed'
                    ELSE 'ok' END AS status,
               CASE l_linenumber WHEN 1 THEN 'Java' WHEN 2 THEN 'Python' WHEN 3 THEN 'Go'
                    WHEN 4 THEN 'Markdown' WHEN 5 THEN 'XML' WHEN 6 THEN 'C++' END AS language,
               CASE WHEN l_tax <> 0 THEN CAST(l_quantity AS BIGINT) END AS n_lines
        FROM lineitem""",
    "totals": """
        SELECT project, sha, min(status) AS status,
               CAST(coalesce(sum(n_lines) FILTER (
                   language IN ('Java', 'Python', 'Go', 'C++') AND status = 'ok'), 0) AS BIGINT) AS loc
        FROM reports GROUP BY project, sha""",
    "delta": """
        SELECT project, sha, CASE WHEN good THEN parent END AS previous_hash,
               CASE WHEN good THEN abs(cur_loc - prev_loc) ELSE 0 END AS tloc,
               log_author
        FROM (
            SELECT c.project, c.sha, c.parent, c.log_author, cur.loc AS cur_loc, prev.loc AS prev_loc,
                   c.parent IS NOT NULL AND coalesce(cur.status, 'checkout_failed') <> 'checkout_failed'
                   AND coalesce(prev.status, 'checkout_failed') <> 'checkout_failed' AS good
            FROM commits c
            LEFT JOIN totals cur ON cur.project = c.project AND cur.sha = c.sha
            LEFT JOIN totals prev ON prev.project = c.project AND prev.sha = c.parent)""",
    "authors": """
        SELECT l.project, l.sha, coalesce(l.stated, c.log_author, 'Unknown') AS author
        FROM listed l LEFT JOIN commits c ON c.project = l.project AND c.sha = l.sha""",
    "times": """
        SELECT l.project, l.sha, c.secs
        FROM listed l JOIN commits c ON c.project = l.project AND c.sha = l.sha""",
    "gaps": """
        SELECT project, CAST(coalesce(round_even(avg(gap), 0), 0) AS BIGINT) AS avg_time
        FROM (SELECT project, secs - lag(secs) OVER (PARTITION BY project ORDER BY secs) AS gap FROM times)
        GROUP BY project""",
    "type_counts": """
        SELECT project, type, count(*) AS n FROM refactorings WHERE type IS NOT NULL
        GROUP BY project, type""",
    "by_author": """
        SELECT a.project, a.author, CAST(sum(coalesce(d.tloc, 0)) AS BIGINT) AS effort
        FROM authors a LEFT JOIN delta d ON d.project = a.project AND d.sha = a.sha
        GROUP BY a.project, a.author""",
    "by_type": """
        SELECT r.project, r.type, CAST(sum(coalesce(d.tloc, 0)) AS BIGINT) AS effort
        FROM refactorings r LEFT JOIN delta d ON d.project = r.project AND d.sha = r.sha
        WHERE r.type IS NOT NULL GROUP BY r.project, r.type""",
    "changes": f"""
        SELECT {_project("key")} AS project, {_sha("key")} AS sha, pos, filename, change_type, diff
        FROM (
            SELECT CASE WHEN doc_id % 3 = 0 THEN 27 ELSE doc_id // 6 END AS key,
                   CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE doc_id % 6 END AS pos,
                   source || '/' || lang || '_' || CAST(n_chars % 97 AS VARCHAR) AS filename,
                   CASE doc_id % 5 WHEN 0 THEN 'ADD' WHEN 1 THEN 'DELETE' WHEN 2 THEN 'RENAME'
                        ELSE 'MODIFY' END AS change_type,
                   CASE WHEN doc_id % 11 = 0 THEN ''
                        WHEN doc_id % 13 <> 0 THEN '+' || replace(replace(replace(replace(text,
                            ', ', chr(10) || '-'), '. ', chr(10) || '+'),
                            ' a', chr(10) || '+++ a'), ' t', chr(13) || chr(10) || '--- t')
                        END AS diff
            FROM documents)""",
    "counted": """
        SELECT project, sha, pos, filename, change_type, diff,
               CAST(len(list_filter(lines, lambda l:
                   starts_with(l, '+') AND NOT starts_with(l, '+++'))) AS BIGINT) AS lines_added,
               CAST(len(list_filter(lines, lambda l:
                   starts_with(l, '-') AND NOT starts_with(l, '---'))) AS BIGINT) AS lines_deleted
        FROM (SELECT *, string_split(replace(coalesce(diff, ''), chr(13), ''), chr(10)) AS lines
              FROM changes)""",
    "stats": """
        SELECT project, sha,
               count(*) FILTER (change_type = 'ADD') AS files_added,
               count(*) FILTER (change_type = 'DELETE') AS files_deleted,
               CAST(sum(lines_added) AS BIGINT) AS lines_added,
               CAST(sum(lines_deleted) AS BIGINT) AS lines_deleted,
               count(*) AS changed
        FROM counted GROUP BY project, sha""",
    "last_wins": """
        SELECT project, sha, filename, first_pos AS pos, pos AS last_pos, nullif(diff, '') AS diff_content,
               lines_added, lines_deleted
        FROM (SELECT *, min(pos) OVER (PARTITION BY project, sha, filename) AS first_pos,
                     row_number() OVER (PARTITION BY project, sha, filename ORDER BY pos DESC) AS back
              FROM counted)
        WHERE back = 1""",
    "analysed": """
        SELECT DISTINCT project, sha FROM listed WHERE l_returnflag = 'R' AND l_linestatus = 'F'""",
    "pending": """
        SELECT c.project, c.sha, c.pos FROM commits c
        WHERE c.on_head AND NOT EXISTS (
            SELECT 1 FROM analysed a WHERE a.project = c.project AND a.sha = c.sha)""",
    "chunks": """
        SELECT project, sha, pos,
               (row_number() OVER (PARTITION BY project ORDER BY pos) - 1) // 100 AS chunk
        FROM pending""",
    "projects": """
        SELECT 'p' || CAST(n_nationkey AS VARCHAR) AS project, n_regionkey FROM nation""",
    "names": """
        SELECT project, min(pos) AS pos FROM (
            SELECT p_partkey AS pos, CASE WHEN p_partkey % 10 < 6 THEN replace(p_name, ' ', '_')
                WHEN p_partkey % 10 = 6 THEN replace(p_name, ' ', '-')
                WHEN p_partkey % 10 = 9 THEN 'a_b_' || CAST(p_size AS VARCHAR) END AS project
            FROM part)
        WHERE project IS NOT NULL GROUP BY project""",
    "urls": """
        SELECT project, pos, 'https://github.com/' || CASE WHEN contains(project, '_')
            THEN replace(project, '_', '/') ELSE 'apache/' || project END AS url
        FROM names WHERE len(string_split(project, '_')) <= 2""",
    "marked": """
        SELECT *, CASE WHEN g % 3 = 0 THEN 0 ELSE 1 + g % 24 END AS repo_no,
               NOT (g % 31 = 30) AND NOT (g % 29 = 20 AND event_id % 2 = 1) AS there
        FROM (SELECT *, event_id // 100 AS g FROM events)""",
    "pages": """
        SELECT 'org' AS owner, 'r' || CAST(repo_no AS VARCHAR) AS repo, g,
               CAST(1 + CASE WHEN g % 3 = 0 THEN g // 3 ELSE g // 24 END AS BIGINT) AS page,
               CASE WHEN g % 23 = 19 THEN 500 ELSE 200 END AS status,
               count(*) FILTER (there) AS n_items
        FROM marked WHERE g % 41 <> 37 GROUP BY repo_no, g""",
    "probe": """
        SELECT 'org' AS owner, 'r' || CAST(repo_no AS VARCHAR) AS repo,
               CASE repo_no % 5 WHEN 1 THEN 404 WHEN 2 THEN 500 ELSE 200 END AS status,
               CASE WHEN repo_no % 8 <> 0
                    THEN count(*) FILTER (event_type = 'error' AND g % 7 < 6) ELSE 0 END AS n_items
        FROM marked GROUP BY repo_no""",
    "trackers": """
        SELECT owner, repo, CASE WHEN status = 404 THEN 'none'
            WHEN status = 200 AND n_items > 0 THEN 'github' ELSE 'error' END AS tracker
        FROM probe""",
    "kept": """
        SELECT * FROM (
            SELECT *, coalesce(max(CASE WHEN status <> 200 OR n_items < 100 THEN 1 ELSE 0 END) OVER (
                PARTITION BY owner, repo ORDER BY page
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
                row_number() OVER (PARTITION BY owner, repo ORDER BY page) AS nth
            FROM pages)
        WHERE stopped = 0 AND status = 200 AND n_items > 0 AND nth = page""",
}

_NEEDS = {
    "refactorings": ["listed"],
    "totals": ["reports"],
    "delta": ["commits", "totals"],
    "authors": ["listed", "commits"],
    "times": ["listed", "commits"],
    "gaps": ["times"],
    "type_counts": ["refactorings"],
    "by_author": ["authors", "delta"],
    "by_type": ["refactorings", "delta"],
    "counted": ["changes"],
    "stats": ["counted"],
    "last_wins": ["counted"],
    "analysed": ["listed"],
    "pending": ["commits", "analysed"],
    "chunks": ["pending"],
    "urls": ["names"],
    "pages": ["marked"],
    "probe": ["marked"],
    "trackers": ["probe"],
    "kept": ["pages"],
}

_DELTA = "SELECT project, sha, previous_hash, CAST(tloc AS BIGINT) AS tloc, {author} AS log_author FROM delta"

# Query -> (views it starts from, statement).
_STATEMENTS = {
    "programming_rows": (
        ["reports"],
        "SELECT * FROM reports WHERE language IN ('Java', 'Python', 'Go', 'C++')",
    ),
    "snapshot_loc": (["totals"], "SELECT project, sha, status, loc FROM totals"),
    "commit_parents": (
        ["commits"],
        "SELECT project, sha, parent AS previous_hash FROM commits WHERE parent IS NOT NULL",
    ),
    "loc_delta": (["delta"], _DELTA.format(author="coalesce(log_author, '')")),
    "tloc_report": (
        ["listed", "delta"],
        """SELECT l.project, l.sha AS refactoring_hash, coalesce(d.previous_hash, 'N/A') AS previous_hash,
                  CASE WHEN d.previous_hash IS NULL THEN 'Unknown'
                       ELSE coalesce(d.log_author, 'Unknown') END AS author,
                  CAST(coalesce(d.tloc, 0) AS BIGINT) AS "TLOC"
           FROM listed l LEFT JOIN delta d ON d.project = l.project AND d.sha = l.sha""",
    ),
    "resolved_authors": (["authors"], "SELECT project, sha, author FROM authors"),
    "effort_by_author": (["by_author"], "SELECT project, author, effort FROM by_author"),
    "effort_by_type": (["by_type"], "SELECT project, type, effort FROM by_type"),
    "effort_objects": (
        ["by_author", "by_type"],
        """SELECT project, 'author' AS map, author AS key, effort FROM by_author
           UNION ALL SELECT project, 'type' AS map, type AS key, effort FROM by_type""",
    ),
    "refactoring_counts": (["type_counts"], "SELECT project, type, n FROM type_counts"),
    "typeless_refactorings": (
        ["refactorings"],
        "SELECT project, sha FROM refactorings WHERE type IS NULL",
    ),
    "refactoring_total": (
        ["listed"],
        """SELECT project, CAST(sum(CASE WHEN type IS NOT NULL THEN n_refactorings ELSE 0 END) AS BIGINT)
               AS total
           FROM listed GROUP BY project""",
    ),
    "commit_times": (
        ["times"],
        "SELECT project, sha, min(secs) AS secs, count(*) AS n FROM times GROUP BY project, sha",
    ),
    "listed_without_time": (
        ["listed", "commits"],
        """SELECT l.project, l.sha, l.author FROM listed l
           WHERE NOT EXISTS (SELECT 1 FROM commits c
               WHERE c.on_head AND c.project = l.project AND c.sha = l.sha)""",
    ),
    "mean_gap": (["gaps"], "SELECT project, avg_time FROM gaps"),
    "refactoring_summary": (
        ["type_counts", "listed", "gaps"],
        """SELECT p.project,
                  '{' || coalesce(string_agg(to_json(t.type) || ':' || CAST(t.n AS VARCHAR), ','
                      ORDER BY t.type), '') || '}' AS counts,
                  CAST(coalesce(sum(t.n), 0) AS BIGINT) AS total,
                  coalesce(min(g.avg_time), 0) AS avg_time
           FROM (SELECT DISTINCT project FROM listed) p
           LEFT JOIN type_counts t ON t.project = p.project
           LEFT JOIN gaps g ON g.project = p.project
           GROUP BY p.project""",
    ),
    "incremental_ingest": (
        ["listed"],
        """SELECT project, sha, authorName AS "authorName", author,
                  CAST(n_refactorings AS BIGINT) AS n_refactorings FROM listed""",
    ),
    "diff_line_counts": (
        ["counted"],
        "SELECT project, sha, pos, filename, change_type, lines_added, lines_deleted FROM counted",
    ),
    "commit_diff_stats": (["stats"], "SELECT * FROM stats"),
    "file_diff_last_wins": (
        ["last_wins"],
        """SELECT project, sha, filename, pos, lines_added, lines_deleted, diff_content
           FROM last_wins""",
    ),
    "file_diff_numbers": (
        ["last_wins"],
        "SELECT project, sha, filename, pos, lines_added, lines_deleted FROM last_wins",
    ),
    "commit_diff_records": (
        ["commits", "stats", "last_wins"],
        """SELECT c.project, c.sha AS commit_hash, c.pos, c.parent AS previous_commit_hash,
                  coalesce(c.log_author, '') AS author, c.author_date AS date, c.message,
                  s.files_added, s.files_deleted, s.lines_added AS lines_added_in_all,
                  s.lines_deleted AS lines_deleted_in_all, s.changed,
                  f.pos AS file_pos, f.filename, f.diff_content, f.lines_added, f.lines_deleted
           FROM commits c
           JOIN stats s ON s.project = c.project AND s.sha = c.sha
           JOIN last_wins f ON f.project = c.project AND f.sha = c.sha
           WHERE c.parent IS NOT NULL""",
    ),
    "diff_job_published": (
        ["commits", "stats", "last_wins"],
        """SELECT c.project, c.sha AS commit_hash, c.pos, c.parent AS previous_commit_hash,
                  coalesce(c.log_author, '') AS author, c.author_date AS date, c.message,
                  s.files_added, s.files_deleted, s.lines_added AS lines_added_in_all,
                  s.lines_deleted AS lines_deleted_in_all, s.changed,
                  f.pos AS file_pos, f.filename, f.diff_content, f.lines_added, f.lines_deleted
           FROM commits c
           JOIN stats s ON s.project = c.project AND s.sha = c.sha
           JOIN last_wins f ON f.project = c.project AND f.sha = c.sha
           WHERE c.parent IS NOT NULL AND c.project <> ''""",
    ),
    "file_change_rejects": (
        ["changes"],
        """SELECT project, sha, pos, count(*) AS n, reason FROM (
               SELECT project, sha, CASE WHEN pos % 7 = 1 THEN pos - 1 ELSE pos END AS pos,
                      CASE WHEN filename IS NULL OR pos % 10 = 3 THEN 'nameless'
                           ELSE 'repeated position' END AS reason
               FROM changes)
           GROUP BY project, sha, pos, reason HAVING reason = 'nameless' OR count(*) > 1""",
    ),
    "file_changes_read": (
        ["changes"],
        "SELECT project, sha, pos, filename, change_type, diff FROM changes",
    ),
    "commits_read": (
        ["commits"],
        "SELECT project, sha, pos, tz AS author_tz, secs FROM commits WHERE pos % 9 <> 4",
    ),
    "loc_reports_read": (["totals"], "SELECT project, sha, status, loc FROM totals"),
    "issue_pages_read": (["pages"], "SELECT owner, repo, page, status, n_items FROM pages"),
    "refactoring_commits_read": (
        ["listed"],
        """SELECT project, sha, authorName AS "authorName", author,
                  CAST(n_refactorings AS BIGINT) AS n_refactorings FROM listed""",
    ),
    "tloc_written": (
        ["listed", "delta"],
        """SELECT l.project, l.sha AS refactoring_hash, coalesce(d.previous_hash, 'N/A') AS previous_hash,
                  CASE WHEN d.previous_hash IS NULL THEN 'Unknown'
                       ELSE coalesce(d.log_author, 'Unknown') END AS author,
                  CAST(coalesce(d.tloc, 0) AS BIGINT) AS "TLOC"
           FROM listed l LEFT JOIN delta d ON d.project = l.project AND d.sha = l.sha""",
    ),
    "effort_written": (
        ["by_author", "by_type"],
        """SELECT project, 'author' AS map, author AS key, effort FROM by_author
           UNION ALL SELECT project, 'type' AS map, type AS key, effort FROM by_type""",
    ),
    "urls_written": (["urls"], "SELECT project, url, pos FROM urls"),
    "issues_written": (
        ["kept", "trackers"],
        """SELECT k.owner, k.repo,
                  '{"id":' || m.event_id || ',"type":"' || m.event_type || '"}' AS value
           FROM kept k JOIN marked m ON m.g = k.g AND m.there
           WHERE EXISTS (SELECT 1 FROM trackers t
               WHERE t.owner = k.owner AND t.repo = k.repo AND t.tracker = 'github')""",
    ),
    "page_gaps": (
        ["pages"],
        """SELECT owner, repo, min(page) AS behind_gap FROM (
               SELECT *, row_number() OVER (PARTITION BY owner, repo ORDER BY page) AS nth FROM pages)
           WHERE nth <> page GROUP BY owner, repo""",
    ),
    "analysed_commits": (["analysed"], "SELECT project, sha FROM analysed"),
    "pending_commits": (["pending"], "SELECT project, sha, pos FROM pending ORDER BY project, pos"),
    "commit_chunks": (["chunks"], "SELECT project, sha, pos, chunk FROM chunks"),
    "chunk_bounds": (
        ["chunks"],
        """SELECT project, chunk, count(*) AS n_commits, arg_min(sha, pos) AS start_commit,
                  arg_max(sha, pos) AS end_commit, string_agg(sha, ',' ORDER BY pos) AS members,
                  'chunk_' || left(arg_min(sha, pos), 8) || '_' || left(arg_max(sha, pos), 8)
                      || '.json' AS chunk_file
           FROM chunks GROUP BY project, chunk""",
    ),
    "commits_newest_first": (
        ["commits"],
        """SELECT project, sha, pos, tz AS author_tz, secs AS authored FROM commits
           ORDER BY project, pos DESC""",
    ),
    "listed_projects": (
        ["commits", "projects"],
        """SELECT project, sha FROM commits
           WHERE project IN (SELECT project FROM projects WHERE n_regionkey <> 2)""",
    ),
    "unprocessed_projects": (
        ["commits", "projects"],
        """SELECT project, sha FROM commits
           WHERE project NOT IN (SELECT project FROM projects WHERE n_regionkey = 0)""",
    ),
    "projects_with_results": (
        ["listed", "projects"],
        "SELECT project FROM projects WHERE project IN (SELECT project FROM listed)",
    ),
    "project_urls": (["urls"], "SELECT project, url, pos FROM urls"),
    "project_name_rejects": (
        ["names"],
        "SELECT project, pos FROM names WHERE len(string_split(project, '_')) > 2",
    ),
    "project_slice": (
        ["urls"],
        """SELECT row_number() OVER (ORDER BY pos) - 1 AS idx, project, url FROM urls
           ORDER BY pos LIMIT 7 OFFSET 10""",
    ),
    "url_objects": (
        ["urls"],
        """SELECT pos // 1000 AS part,
                  '{' || string_agg(to_json(project) || ':' || to_json(url), ',' ORDER BY pos) || '}'
                      AS value
           FROM urls GROUP BY 1""",
    ),
    "tracker_status": (["trackers"], "SELECT owner, repo, tracker FROM trackers"),
    "issue_pages_kept": (["kept"], "SELECT owner, repo, page, n_items FROM kept"),
    "issues": (
        ["kept", "trackers"],
        """SELECT k.owner, k.repo, k.page,
                  CAST(row_number() OVER (PARTITION BY k.g ORDER BY m.event_id) - 1 AS INTEGER) AS pos,
                  '{"id":' || m.event_id || ',"type":"' || m.event_type || '"}' AS issue
           FROM kept k JOIN marked m ON m.g = k.g AND m.there
           WHERE EXISTS (SELECT 1 FROM trackers t
               WHERE t.owner = k.owner AND t.repo = k.repo AND t.tracker = 'github')""",
    ),
    "issue_counts": (
        ["pages", "kept"],
        """SELECT p.owner, p.repo, CAST(coalesce(sum(k.n_items), 0) AS BIGINT) AS n_issues
           FROM pages p LEFT JOIN kept k ON k.repo = p.repo AND k.page = p.page
           GROUP BY p.owner, p.repo""",
    ),
}


def _with_needs(names: list[str], done: list[str]) -> list[str]:
    for name in names:
        if name not in done:
            _with_needs(_NEEDS.get(name, []), done)
            done.append(name)
    return done


def _sql(views: list[str], statement: str) -> str:
    ctes = ",\n".join(f"{v} AS ({_VIEWS[v]})" for v in _with_needs(views, []))
    return f"WITH {ctes}\n{statement}"


ORACLE = {name: _sql(*parts) for name, parts in _STATEMENTS.items()}
