"""Session settings the operators count on, and where durable scratch data goes."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Everything here is a runtime SQL setting; executors, memory and shuffle
# partition counts belong to the cluster's own spark-submit configuration.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Left sides keyed by commit or project may be skewed; their right sides are
    # unique per key, so splitting the left side is always possible.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Hash instead of sort where every partition of a join is measured to fit.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Rerunning a job replaces only the projects it produced.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


_own_dirs: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it.

    Only a local master, where driver and executors share one disk, may leave it unset:
    it gets one temporary folder for each application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _own_dirs:
        _own_dirs[application] = tempfile.mkdtemp(prefix="chronolode-")
    return _own_dirs[application]
