"""Readers (S1-S8).

JSON documents that span lines cannot be split, so each file is one task's record;
land them as Parquet once (``streaming.ingest_chunks``) and read that from then on.
Malformed input goes to a reject table and is never deleted.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql.types import StructType
from pyspark.sql import functions as F

from .. import schemas
from ..functions import offset_of, parse_author_time, parse_committer_time, strip
from ..operators.loc import OK, TOOL_FAILED
from ..operators.membership import not_in, with_hash


# Longest text the JSON reader takes; its own default drops rows with longer diffs.
JSON_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt_record",
    "maxStringLen": 2147483647,
}


def read_table(
    spark: SparkSession, path: str, schema, fmt: str = "parquet"
) -> tuple[DataFrame, DataFrame]:
    """Landed table with a fixed schema as (rows, rejects); ``fmt`` is parquet, orc or json lines.

    A JSON line that cannot be read, or not as the schema, is a reject: its file, its text,
    and its first column as far as it was read. The other formats have no rejects.
    """
    if fmt != "json":
        rows = spark.read.schema(schema).format(fmt).load(path)
        return rows, spark.createDataFrame([], "file string, record string, key string")
    raw = spark.read.schema(f"{schema}, _corrupt_record string").options(**JSON_OPTIONS).json(path)
    bad = F.col("_corrupt_record").isNotNull()
    # Whether a line is as the schema shows only in the columns that are read: the second
    # condition, always true, reads them all whatever the query prunes.
    read = F.xxhash64(*raw.columns[:-1]) % 2 < 2
    rejects = raw.where(bad & read).select(
        decoded_path().alias("file"),
        F.col("_corrupt_record").alias("record"),
        F.col(raw.columns[0]).cast("string").alias("key"),
    )
    return raw.where(~bad & read).drop("_corrupt_record"), rejects


def _in_file_order(rows: DataFrame) -> DataFrame:
    """Number the rows of a scan densely as ``pos``: by file name, then by place in the file.

    Spark packs pieces of files by size, so its own row ids do not follow the files. Rows
    are numbered inside the piece they were read from; the only window runs over one row
    per piece.
    """
    tagged = rows.withColumns(
        {
            "_file": F.col("_metadata.file_path"),
            "_start": F.col("_metadata.file_block_start"),
            "_id": F.monotonically_increasing_id(),
        }
    )
    pieces = tagged.groupBy("_file", "_start").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")
    )
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        "_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return (
        tagged.join(pieces, ["_file", "_start"])
        .withColumn("pos", F.col("_before") + F.col("_id") - F.col("_first"))
        .drop("_file", "_start", "_id", "_first", "_before")
    )


def read_measures(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """First CSV column, one whole comma-joined row each, with its place in file order.

    A quoted field may hold line breaks. Files known to have none can be split with
    ``multi_line`` off.
    """
    return _in_file_order(
        spark.read.schema(schemas.MEASURES)
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )


def read_projects(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Project names of a JSON list: the keys of an object or the elements of an array.

    With ``lines`` every line is such a document. A name's place is its first one: the
    document's number and the place ``i`` in it.
    """
    text = _in_file_order(spark.read.text(path, wholetext=not lines))
    keys = F.map_keys(F.from_json("value", "map<string,string>"))
    names = F.coalesce(keys, F.from_json("value", "array<string>"))
    return (
        text.select(F.col("pos").alias("doc"), F.posexplode(names).alias("i", "project"))
        .groupBy("project")
        .agg(F.min(F.struct("doc", "i")).alias("at"))
        .select("project", "at.doc", "at.i")
    )


def read_commits(
    spark: SparkSession, path: str, fmt: str = "parquet"
) -> tuple[DataFrame, DataFrame]:
    """Exported commit log with parsed times as (rows, rejects); texts stay beside the instants."""
    log, rejects = read_table(spark, path, schemas.COMMIT_LOG, fmt)
    return with_hash(with_times(log)), rejects


def with_times(log: DataFrame) -> DataFrame:
    author, committer = strip(F.col("author_date")), strip(F.col("committer_date"))
    return log.withColumns(
        {
            "sha": strip(F.col("sha")),
            "author_name": strip(F.col("author_name")),
            "author_ts": parse_author_time(author),
            "author_tz": offset_of(author),
            "committer_ts": parse_committer_time(committer),
        }
    )


def decoded_path() -> Column:
    # File paths arrive URL-encoded; a literal plus sign is not a blank.
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def glob_free(path: str) -> str:
    """A path that stands for itself where readers take patterns."""
    return re.sub(r"([\\*?\[\]{}^])", r"\\\1", path)


# These run for every record of a file. A pattern anchored at the end of a whole path is tried
# from each of its characters, so the path is cut at its slashes first.
def folder(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "/", -2), "/", 1)


def stem(path: Column) -> Column:
    return F.regexp_extract(F.substring_index(path, "/", -1), r"([^/]+?)(\.[^./]+)?$", 1)


def tag_chunks(raw: DataFrame) -> DataFrame:
    project = F.regexp_replace(folder(F.col("file")), "^project=", "")
    modified = F.col("_metadata.file_modification_time")
    return raw.withColumns({"file": decoded_path(), "modified": modified}).withColumn("project", project)


def valid_chunk() -> Column:
    return F.col("commits").isNotNull() & F.col("_corrupt_record").isNull()


def chunk_options(multi_line: bool) -> dict[str, object]:
    return {
        **JSON_OPTIONS,
        "multiLine": multi_line,
        "recursiveFileLookup": True,
    }


def read_chunks(
    spark: SparkSession, path: str, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Chunk files of ``<path>/<project>/*`` as (valid, rejects).

    A file is one document; without ``multi_line`` each of its lines is one, and the
    file can be split.
    """
    reader = spark.read.schema(schemas.CHUNK_FILE).options(**chunk_options(multi_line))
    raw = tag_chunks(reader.json(path))
    ok = raw.where(valid_chunk()).select("project", "file", "commits")
    # One row per file, however many records its broken text fell into.
    rejects = raw.where(~valid_chunk()).select("project", "file").distinct()
    return ok, rejects


def read_refactoring_commits(
    spark: SparkSession, path: str, fmt: str = "parquet"
) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, path, schemas.REFACTORING_COMMITS, fmt)


def read_file_changes(
    spark: SparkSession, path: str, fmt: str = "parquet"
) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, path, schemas.FILE_CHANGES, fmt)


def read_loc_reports(
    spark: SparkSession, path: str, manifest: DataFrame | None = None
) -> DataFrame:
    """Line reports of ``<path>/<project>/<sha>.json``, arrays of ``{Name, Lines}``.

    Read as whole texts, because the three outcomes must stay apart: an empty array is
    a measured snapshot without lines, a malformed text is a failed tool, and no file at
    all is no snapshot. Spark skips files of zero bytes; ``manifest(project, sha)`` names
    the snapshots the tool ran on, and one without a report is a failed tool as well.
    """
    body = F.from_json("value", schemas.LOC_REPORT_BODY)
    reports = (
        spark.read.option("recursiveFileLookup", True)
        .text(path, wholetext=True)
        .select(decoded_path().alias("file"), body.alias("body"))
        .select(
            folder(F.col("file")).alias("project"),
            stem(F.col("file")).alias("sha"),
            F.when(F.col("body").isNull(), TOOL_FAILED).otherwise(OK).alias("status"),
            F.explode_outer("body").alias("row"),
        )
        .select(
            "project",
            "sha",
            "status",
            F.col("row.Name").alias("language"),
            F.col("row.Lines").alias("n_lines"),
        )
    )
    if manifest is None:
        return reports
    silent = not_in(manifest.select("project", "sha").distinct(), reports, ["project", "sha"])
    return reports.unionByName(
        silent.withColumn("status", F.lit(TOOL_FAILED)), allowMissingColumns=True
    )


def read_loc_table(
    spark: SparkSession, path: str, fmt: str = "parquet"
) -> tuple[DataFrame, DataFrame]:
    """Line reports already landed as one row per language, and rejects.

    A row without project or hash names no snapshot and is a reject too.
    """
    rows, rejects = read_table(spark, path, schemas.LOC_REPORTS, fmt)
    named = F.col("project").isNotNull() & F.col("sha").isNotNull()
    nameless = rows.where(~named).select(
        F.lit(None).cast("string").alias("file"),
        F.to_json(F.struct(*rows.columns)).alias("record"),
        F.col("project").alias("key"),
    )
    return rows.where(named), rejects.unionByName(nameless)


def read_issue_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Landed issue pages, one JSON line each, and rejects; an issue keeps its raw text."""
    return read_table(spark, path, schemas.ISSUE_PAGES, "json")


def read_issue_probe(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, path, schemas.ISSUE_PROBE, "json")


def finished_projects(spark: SparkSession, ledger: str) -> DataFrame:
    """Projects in a ledger written by ``writers.publish_done``; none before the first run."""
    try:
        done = spark.read.schema("project string, run string").parquet(ledger)
        done.inputFiles()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "project string")
    return done.select("project").distinct()


def read_commit_diffs(
    spark: SparkSession, path: str, heads_schema: StructType | str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The diff sink as published: (commits, changed files) of the projects in its ledger.

    Rows of a project whose job stopped before its ledger entry are not seen, so the two
    tables always hold the same projects, each once.
    """
    done = finished_projects(spark, f"{path}/done")
    heads = spark.read
    if heads_schema is not None:
        heads = heads.schema(heads_schema)
    heads = heads.json(f"{path}/commits")
    files = spark.read.parquet(f"{path}/files")
    return heads.join(done, "project", "left_semi"), files.join(done, "project", "left_semi")

