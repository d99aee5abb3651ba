"""The driver's tables seen as mining facts.

Every view covers its whole table. Keys follow from dense integer keys of the
driver's tables, so no view needs a sort or a window. They are skewed on purpose:
project ``p0``, repository ``r0`` and commit 27 hold a third of their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.sources.readers import with_times

HOT_COMMIT = 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: Column) -> Column:
    return c.cast("string")


def _sha(key: Column) -> Column:
    return F.md5(_text(key))


def _hot(key: Column) -> Column:
    return key % 3 == 0


def _project(key: Column) -> Column:
    return F.when(_hot(key), "p0").otherwise(F.concat(F.lit("p"), _text(1 + key % 24)))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per order; the parent is the project's previous order."""
    key = F.col("o_orderkey")
    step = F.when(_hot(key), 3).otherwise(24)
    parents = (
        F.when(key < step, F.array().cast("array<string>"))
        .when((key % 10 == 0) & (key >= 2 * step), F.array(_sha(key - step), _sha(key - 2 * step)))
        .otherwise(F.array(_sha(key - step)))
    )
    name = F.concat(F.lit("Customer#"), F.lpad(_text(F.col("o_custkey")), 9, "0"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    time = F.date_format("o_orderdate", "HH:mm:ss")
    hours = F.concat(F.lit("+0"), _text(key % 5))
    log = table(spark, sf_dir, "orders").select(
        _project(key).alias("project"),
        _sha(key).alias("sha"),
        key.alias("pos"),
        parents.alias("parents"),
        F.when(F.col("o_custkey") % 17 == 0, "").otherwise(name).alias("author_name"),
        F.concat(day, F.lit("T"), time, hours, F.lit(":00")).alias("author_date"),
        F.concat(day, F.lit(" "), time, F.lit(" "), hours, F.lit("00")).alias("committer_date"),
        F.col("o_orderpriority").alias("message"),
        (F.col("o_orderstatus") != "P").alias("on_head"),
    )
    return with_times(log)


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing per order line with 0 to 3 refactorings; hashes repeat."""
    supplier, line = F.col("l_suppkey"), F.col("l_linenumber")
    kind = F.when(F.col("l_discount") != 0, F.concat("l_returnflag", "l_linestatus"))
    stated = supplier % 5
    return table(spark, sf_dir, "lineitem").select(
        _project(F.col("l_orderkey")).alias("project"),
        _sha(F.col("l_orderkey")).alias("sha"),
        F.when(stated == 0, F.concat(F.lit("Supplier#"), _text(supplier)))
        .when(stated == 2, "")
        .alias("authorName"),
        F.when(stated == 1, F.concat(F.lit('{"name":"Dev '), _text(supplier), F.lit('"}')))
        .when(stated == 2, F.concat(F.lit("Plain "), _text(supplier)))
        .when(stated == 3, '{"x":1}')
        .alias("author"),
        F.when(line != 4, F.array_repeat(F.struct(kind.alias("type")), line % 4)).alias(
            "refactorings"
        ),
        "l_returnflag",
        "l_linestatus",
    )


def analysed_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir).where("l_returnflag = 'R' and l_linestatus = 'F'")


def loc_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One language row per order line; orders without lines have no report."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    status = (
        F.when(key % 50 == 7, "tool_failed").when(key % 50 == 8, "checkout_failed").otherwise("ok")
    )
    language = (
        F.when(line == 1, "Java")
        .when(line == 2, "Python")
        .when(line == 3, "Go")
        .when(line == 4, "Markdown")
        .when(line == 5, "XML")
        .when(line == 6, "C++")
    )
    return table(spark, sf_dir, "lineitem").select(
        _project(key).alias("project"),
        _sha(key).alias("sha"),
        status.alias("status"),
        language.alias("language"),
        F.when(F.col("l_tax") != 0, F.col("l_quantity").cast("bigint")).alias("n_lines"),
    )


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One changed file per document, its text turned into diff lines."""
    doc = F.col("doc_id")
    key = F.when(_hot(doc), F.lit(HOT_COMMIT)).otherwise(F.expr("doc_id div 6"))
    diff = F.col("text")
    for found, put in ((", ", "\n-"), (". ", "\n+"), (" a", "\n+++ a"), (" t", "\r\n--- t")):
        diff = F.replace(diff, F.lit(found), F.lit(put))
    kind = F.get(F.array(*map(F.lit, ("ADD", "DELETE", "RENAME", "MODIFY", "MODIFY"))), doc % 5)
    name = F.concat("source", F.lit("/"), "lang", F.lit("_"), _text(F.col("n_chars") % 97))
    return table(spark, sf_dir, "documents").select(
        _project(key).alias("project"),
        _sha(key).alias("sha"),
        F.when(_hot(doc), doc).otherwise(doc % 6).alias("pos"),
        name.alias("filename"),
        kind.alias("change_type"),
        F.when(doc % 11 == 0, "")
        .when(doc % 13 != 0, F.concat(F.lit("+"), diff))
        .alias("diff"),
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("g")
    return (
        table(spark, sf_dir, "events")
        .withColumn("g", F.expr("event_id div 100"))
        .withColumn("repo_no", F.when(_hot(page), 0).otherwise(1 + page % 24))
        .withColumn("repo", F.concat(F.lit("r"), _text(F.col("repo_no"))))
    )


def issue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per hundred events, some bad, some short, some empty."""
    page = F.col("g")
    there = ~(page % 31 == 30) & ~((page % 29 == 20) & (F.col("event_id") % 2 == 1))
    text = F.concat(
        F.lit('{"id":'), _text(F.col("event_id")), F.lit(',"type":"'), "event_type", F.lit('"}')
    )
    in_order = F.array_sort(F.collect_list(F.when(there, F.struct("event_id", text.alias("t")))))
    return (
        _events(spark, sf_dir)
        # Some pages are missing altogether.
        .where(page % 41 != 37)
        .groupBy("repo", "g")
        .agg(F.transform(in_order, lambda e: e["t"]).alias("issues"))
        .select(
            F.lit("org").alias("owner"),
            "repo",
            (1 + F.when(_hot(page), F.expr("g div 3")).otherwise(F.expr("g div 24"))).alias("page"),
            F.when(page % 23 == 19, 500).otherwise(200).alias("status"),
            "issues",
        )
    )


def issue_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("repo_no") % 5 == 1, 404).when(F.col("repo_no") % 5 == 2, 500)
    return (
        _events(spark, sf_dir)
        .groupBy("repo", "repo_no")
        .agg(F.count_if((F.col("event_type") == "error") & (F.col("g") % 7 < 6)).alias("n"))
        .select(
            F.lit("org").alias("owner"),
            "repo",
            status.otherwise(200).alias("status"),
            F.when(F.col("repo_no") % 8 != 0, F.col("n")).otherwise(0).alias("n_items"),
        )
    )


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-joined rows, some short, without a name or with too many underscores."""
    key = F.col("p_partkey")
    name = (
        F.when(key % 10 < 6, F.replace("p_name", F.lit(" "), F.lit("_")))
        .when(key % 10 == 6, F.replace("p_name", F.lit(" "), F.lit("-")))
        .when(key % 10 == 7, "")
        .otherwise(F.concat(F.lit("a_b_"), _text(F.col("p_size"))))
    )
    row = F.when(key % 10 == 8, _text(key)).otherwise(F.concat(_text(key), F.lit(","), name, F.lit(",z")))
    return table(spark, sf_dir, "part").select(row.alias("_c0"), key.alias("pos"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("p"), _text(key)).alias("project"), key.alias("pos"), "n_regionkey"
    )
