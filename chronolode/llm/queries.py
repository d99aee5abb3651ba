"""Registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.llm import (
    curriculum,
    decontamination,
    extraction,
    hard_negatives,
    jaccard,
    language,
    line_dedup,
    lm,
    pii,
    quality,
    spelling,
    token_lengths,
    url_rules,
)
from chronolode.llm.common import ship, table
from chronolode.session import configure


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the library; small batches of long texts, no shuffles left on disk."""
    configure(spark)
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    # Operators write many steps; the shuffles of one are of no use to the next.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its lines and how many of them go; ``removed`` as comma-joined numbers."""
    prepare(spark)
    report = line_dedup.line_report(table(spark, sf_dir, "documents"))
    return report.withColumn("removed", F.array_join(F.transform("removed", lambda x: x.cast("string")), ","))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return extraction.extract(table(spark, sf_dir, "pages"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it."""
    prepare(spark)
    return decontamination.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language.identify(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    lengths = token_lengths.encoded_lengths(table(spark, sf_dir, "documents"))
    return token_lengths.length_histogram(lengths)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return lm.score(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pii.find(table(spark, sf_dir, "documents"))


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, in the order in which the schedules first take them."""
    prepare(spark)
    return curriculum.first_taken_order(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken",
        F.size("positions").alias("passes"),
    )


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard.components(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return url_rules.judge(table(spark, sf_dir, "pages")).select(
        "page_id", "host", "path", "rule", "verdict", "url"
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: DuckDB has no crc32; the tests compare it with a brute-force version."""
    prepare(spark)
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_line_dedup": op2_line_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_language_id": op5_language_id,
    "op6_token_counts": op6_token_counts,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_pii": op8_pii,
    "op9_curriculum_mix": op9_curriculum_mix,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_url_filters": op12_url_filters,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE: dict[str, str] = {
    "op2_line_dedup": r"""
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, i - 1 AS line,
         list_distinct(regexp_extract_all(translate(l[i],
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS w
  FROM split, unnest(range(1, len(l) + 1)) AS t(i)
), sets AS (
  SELECT doc_id, line, list_sort(w) AS w, len(w) AS n FROM lines WHERE len(w) >= 5
), nodes AS (
  SELECT w, n, min((doc_id, line)) AS first, row_number() OVER () AS node FROM sets GROUP BY w, n
), tokens AS (
  SELECT node, n, first, unnest(w) AS token FROM nodes
), shared AS (
  SELECT a.node, count(*) AS o, a.n AS m, b.n AS n
  FROM tokens a JOIN tokens b
    ON a.token = b.token AND b.first < a.first AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n
), matched AS (
  SELECT DISTINCT node FROM shared WHERE 100 * o >= 80 * (m + n - o)
), gone AS (
  SELECT DISTINCT s.doc_id, s.line
  FROM sets s JOIN nodes USING (w, n) LEFT JOIN matched g USING (node)
  WHERE (s.doc_id, s.line) > nodes.first OR g.node IS NOT NULL
), removed AS (
  SELECT doc_id, count(*) AS n_removed, string_agg(line::VARCHAR, ',' ORDER BY line) AS removed
  FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines,
       coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN removed r ON r.doc_id = d.doc_id
""",
    "op9_curriculum_mix": r"""
WITH rows AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM rows GROUP BY source
), weighed AS (
  SELECT *, ((rank - 1) % 3 + 1)::DOUBLE AS weight, 3 * source_size AS most,
         3 * source_size / ((rank - 1) % 3 + 1)::DOUBLE AS level
  FROM sources
), filled AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce((sum(most) OVER (ORDER BY level, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))
         / sum(weight) OVER (ORDER BY level, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fair
  FROM weighed
), turn AS (
  SELECT *, row_number() OVER (ORDER BY level, source NULLS LAST) AS place FROM filled
), first_open AS (
  SELECT min(place) AS turn FROM turn WHERE level > fair
), targets AS (
  SELECT source, source_size,
         CASE WHEN place >= (SELECT turn FROM first_open)
              THEN (SELECT fair FROM turn, first_open WHERE place = first_open.turn) * weight
              ELSE most::DOUBLE END AS target
  FROM turn
), placed AS (
  SELECT r.*, t.source_size, t.target,
         coalesce((sum(r.size) OVER (PARTITION BY r.source ORDER BY key, doc_id, size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) + r.size / 2 AS middle
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE least(3, floor(target / source_size)
         + (middle <= target - floor(target / source_size) * source_size)::INT) END::INTEGER AS passes
  FROM placed
)
SELECT doc_id, size, source_size, target, (passes * size)::BIGINT AS taken, passes FROM taken
""",
    "op10_ngram_jaccard_join": r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM split, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i)
  WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared
  JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * o >= 75 * (x.n + y.n - o)
), reach AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles,
       least(d.doc_id, coalesce(b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
""",
    "op11_hard_negatives": r"""
WITH kept AS (
  SELECT DISTINCT vec_id::BIGINT AS vec_id,
         (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::INTEGER AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), anchors AS (
  SELECT * FROM kept WHERE vec_id % 100 = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS id,
         coalesce(list_sum(list_transform(range(1, greatest(len(a.e), len(c.e)) + 1),
           lambda i: coalesce(a.e[i], 0) * coalesce(c.e[i], 0))), 0)::BIGINT AS score
  FROM anchors a, kept c
), positives AS (
  SELECT * FROM (
    SELECT anchor_id, id AS positive_id, score AS positive_score,
           row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r
    FROM scored WHERE same AND id <> anchor_id) WHERE r <= 5
), negatives AS (
  SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 5
""",
    "op12_url_filters": r"""
WITH rules(host, path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), urls AS (
  SELECT page_id, url,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), judged AS (
  SELECT u.*, (SELECT r.host || r.path FROM rules r
               WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
               ORDER BY length(r.host) + length(r.path) DESC, r.verdict = 'block' DESC, r.host || r.path
               LIMIT 1) AS rule
  FROM urls u
)
SELECT page_id, host, path, rule,
       coalesce((SELECT verdict FROM rules r WHERE r.host || r.path = judged.rule LIMIT 1), 'allow') AS verdict,
       url
FROM judged
""",
}
