"""The library without its training-data part: the driver file imports and a core query runs."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

SCRIPT = """
import __spark_entry__ as driver
from pyspark.sql import SparkSession
assert not any(name.startswith("op") for name in driver.queries()), "llm queries left"
assert "pipeline" not in driver.queries()
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
print(driver.entry(spark).count())
"""


def _tree(tmp_path: Path, keep_pipeline: bool) -> Path:
    tree = tmp_path / "tree"
    shutil.copytree(
        ROOT, tree, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", "*.parquet")
    )
    shutil.rmtree(tree / "chronolode" / "llm")
    shutil.rmtree(tree / "tests" / "llm")
    if not keep_pipeline:
        (tree / "corpus_pipeline.py").unlink()
    return tree


def _run(tree: Path) -> subprocess.CompletedProcess:
    return subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tree, capture_output=True, text=True, timeout=600
    )


def test_driver_file_without_llm_and_pipeline(tmp_path):
    done = _run(_tree(tmp_path, keep_pipeline=False))
    assert done.returncode == 0, done.stderr[-3000:]
    assert int(done.stdout.strip().splitlines()[-1]) > 0


def test_driver_file_without_llm_but_with_pipeline(tmp_path):
    done = _run(_tree(tmp_path, keep_pipeline=True))
    assert done.returncode == 0, done.stderr[-3000:]
