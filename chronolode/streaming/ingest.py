"""Land newly arrived chunk files once.

The stream's checkpoint remembers which files were read, so a restart goes on with
the new ones. Each micro-batch writes into its own ``batch`` partition with overwrite:
a batch replayed after a failure replaces what its first attempt left. No state is
kept per hash; repeated hashes are removed on request when the table is read.
"""

from __future__ import annotations

import time
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.membership import forget_partitioning
from ..operators.refactorings import first_listings, listing_fields
from ..sources.readers import chunk_options, decoded_path, glob_free, tag_chunks, valid_chunk

_LANDED = (
    f"{schemas.REFACTORING_COMMITS}, file string, modified timestamp, pos int, batch bigint, "
    "valid boolean"
)
# Files repaired since they were rejected are read in runs of so many paths.
PATHS_PER_READ = 1000


def _landing(raw: DataFrame) -> DataFrame:
    """Listings and rejects of chunk documents; a document without listings leaves its name."""
    commits = F.when(F.col("valid"), F.col("commits"))
    return (
        raw.withColumn("valid", valid_chunk())
        .select("project", "file", "modified", "valid", F.posexplode_outer(commits).alias("pos", "c"))
        .select("project", *listing_fields("c"), "file", "modified", "pos", "valid")
    )


def _land(rows: DataFrame, target: str, batch: int) -> None:
    rows.hint("rebalance", "project").write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).partitionBy("valid", "project").parquet(f"{target}/batch={batch}")


def ingest_chunks(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str | None = None,
    multi_line: bool = True,
    files_per_batch: int = 10_000,
) -> None:
    """Read the chunk files of ``<source>/<project>/`` that are new since the last run.

    Listings and rejects leave in one pass over the files, as partitions of the target, by
    project. Unless told otherwise, the progress is kept in the target too, hidden from
    readers by its leading underscore. A file is new however old its time is. Files that
    were rejected and have been written again since are read again; their newest version
    counts.
    """
    checkpoint = checkpoint or f"{target}/_checkpoint"
    _ingest_repaired(spark, source, target, multi_line)
    raw = tag_chunks(
        spark.readStream.schema(schemas.CHUNK_FILE)
        .options(**chunk_options(multi_line))
        .option("maxFilesPerTrigger", files_per_batch)
        # By default files a week older than the newest are passed over.
        .option("maxFileAge", "36500d")
        .json(source)
    )

    def land(batch: DataFrame, batch_id: int) -> None:
        _land(batch, target, batch_id)

    query = (
        _landing(raw)
        .writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _ingest_repaired(spark: SparkSession, source: str, target: str, multi_line: bool) -> None:
    """Land the files whose last version was rejected and that are newer now."""
    try:
        rejected = _newest(spark, target).where(~F.col("valid"))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(source)
        .select(decoded_path().alias("file"), F.col("modificationTime").alias("now"))
    )
    paths = (
        listing.join(rejected, "file").where("now > modified").select("file").toLocalIterator()
    )
    batch = -time.time_ns() // 1000
    while some := [glob_free(r.file) for r in islice(paths, PATHS_PER_READ)]:
        raw = spark.read.schema(schemas.CHUNK_FILE).options(**chunk_options(multi_line)).json(some)
        _land(_landing(tag_chunks(raw)), target, batch)
        batch -= 1


def _landed(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(_LANDED).parquet(target)


def _newest(spark: SparkSession, target: str) -> DataFrame:
    """Per file its newest version that was read, and whether that was valid throughout."""
    versions = (
        _landed(spark, target)
        .groupBy("project", "file", "modified")
        .agg(F.bool_and("valid").alias("valid"))
    )
    return (
        versions.groupBy("project", "file")
        .agg(F.max(F.struct("modified", "valid")).alias("last"))
        .select("project", "file", "last.modified", "last.valid")
    )


def landed_commits(spark: SparkSession, target: str, dedup: bool = False) -> DataFrame:
    """Every landed listing; with ``dedup`` the first listing of each hash."""
    landed = _landed(spark, target).where("valid and pos is not null").drop("valid")
    # What a repaired file held before is superseded; batches of repairs are below zero.
    repaired = (
        _landed(spark, target)
        .where("batch < 0")
        .groupBy("file")
        .agg(F.max("modified").alias("_since"))
    )
    landed = (
        landed.join(forget_partitioning(repaired, "file"), "file", "left")
        .where("_since is null or modified >= _since")
        .drop("_since")
    )
    return first_listings(landed, "batch", "file", "pos") if dedup else landed


def landed_rejects(spark: SparkSession, target: str) -> DataFrame:
    """Files whose newest version could not be used, however many broken records it gave."""
    return _newest(spark, target).where(~F.col("valid")).select("project", "file")
