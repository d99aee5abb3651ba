"""Compare every registered query with its SQL: ``python -m checks.compare [dir] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from .oracle import ORACLE
from .queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    frame = frame.apply(lambda c: c.map(lambda v: "<null>" if pd.isna(v) else str(v)))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def difference(spark: SparkSession, con, name: str, sf_dir: str) -> str | None:
    """What differs between the query and its SQL, or None."""
    got_df = QUERIES[name](spark, sf_dir)
    want_table = con.sql(ORACLE[name]).to_arrow_table()
    names = set(want_table.column_names)
    if names != set(got_df.columns):
        return f"columns {sorted(got_df.columns)} against {sorted(names)}"
    got_table = got_df.toArrow()
    for column in sorted(names):
        a, b = got_table.schema.field(column).type, want_table.schema.field(column).type
        if str(a).replace("large_", "") != str(b).replace("large_", ""):
            return f"type of {column}: {a} against {b}"
    kinds = {"types_mapper": pd.ArrowDtype}
    got = canonical(got_table.to_pandas(**kinds))
    want = canonical(want_table.to_pandas(**kinds))
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    if not got.equals(want):
        bad = (got != want).any(axis=1)
        return f"{bad.sum()} rows differ, first:\n{got[bad].head(2)}\n{want[bad].head(2)}"
    return None


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = 0
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            problem = difference(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        print(f"{name:24} {'ok' if problem is None else problem}  {time.time() - start:.1f}s", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
