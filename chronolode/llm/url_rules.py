"""URL filters: allow and block rules on host suffixes and path prefixes, by a sorted sweep.

A rule (host, path) fits a url whose host is the rule's host or one of its subdomains and whose
path starts with the rule's path; of the fitting rules the longest wins. Hosts are written with
their labels reversed and a closing dot (``www.example.com`` -> ``com.example.www.``), so that a
rule fits a url's host exactly when the rule's key is a prefix of the url's key: each rule becomes
the interval of keys that start with its own, and two such intervals are nested or apart.

The sweep puts rules and urls into one order of keys (a range-partitioned sort; rules first
on equal keys) and gives each url the last rule that opened before it. The rules still open
at that point are that rule and those of its enclosing hosts — its stack, worked out once per
rule from the rules alone — minus those already closed, which are the ones whose key is not a
prefix of the url's key. So a url looks at one stack of a few nested rules, never at all rules.

The order is cut into ranges (``repartitionByRange``) that are swept each in their own task;
a range that starts inside an open rule takes the last rule opened in any earlier range,
found on a table of one row per range. Everything is DataFrame functions: no Python runs
on the rows.

Defined cases: a NULL url, or one without ``://``, has an empty host and path and no rule; so
has a url whose host or path a rule does not fit. A url without a rule gets ``DEFAULT``. Hosts
are lower-cased in A-Z only; paths keep their case. Of two fitting rules of equal length
(possible only with rules given by the caller), ``block`` wins, then the smaller rule text.
Repeated pages give repeated rows; extra columns of ``pages`` are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolode.llm.common import LOWER, UPPER, stored

# The rules of the contract, as (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
# Verdict of a url that no rule fits.
DEFAULT = "allow"
# Rows (rules and urls) of one sweep range, on average.
RANGE_ROWS = 2_000_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse order, then a dot: a rule's key is a prefix of its subdomains' keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rules with their key and their stack: themselves and every rule of an enclosing host."""
    df = spark.createDataFrame(rules, "host string, path string, verdict string").select(
        F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict"
    )
    df = df.select(
        "host", "path", "verdict",
        host_key(F.col("host")).alias("key"),
        F.concat("host", "path").alias("rule"),
        (F.length("host") + F.length("path")).alias("length"),
    )
    # The keys of a rule's enclosing hosts are the prefixes of its key at label ends: an
    # equi-join with them finds its stack.
    labels = F.reverse(F.split("host", r"\."))
    enclosing = df.select(
        F.col("key").alias("inner"),
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(labels)),
                lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")),
            )
        ).alias("key"),
    ).distinct()
    stacks = (
        enclosing.join(df, "key")
        .groupBy("inner")
        .agg(F.collect_set(F.struct("key", "path", "rule", "length", "verdict")).alias("stack"))
        .withColumnRenamed("inner", "key")
    )
    return stacks


def judge(pages: DataFrame, rules: DataFrame | None = None, default: str = DEFAULT) -> DataFrame:
    """Per page: page_id, url, host, path, rule (NULL if none fits) and verdict.

    ``rules`` as made by ``rule_table``; the fixed ``RULES`` if not given.
    """
    spark = pages.sparkSession
    rules = rules if rules is not None else rule_table(spark)
    urls = pages.select(
        F.col("page_id"),
        F.col("url"),
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
    ).withColumn("key", host_key(F.col("host")))
    # On equal keys rules come first; urls of one key are spread by a hash of their row, so a
    # host that holds a third of all urls still fills many ranges.
    events = urls.select(
        "key", F.lit(1).alias("kind"), F.xxhash64("page_id", "url").alias("salt"),
        "page_id", "url", "host", "path", F.lit(None).cast("string").alias("opened"),
    ).unionByName(
        rules.select(
            "key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("salt"),
            F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"),
            F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
            F.col("key").alias("opened"),
        )
    )
    order = ["key", "kind", "salt"]
    # Ranges of the order, each swept by one task; fixed once written.
    ranges = max(1, -(-events.count() // RANGE_ROWS))
    swept = stored(
        events.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()),
        "url-sweep",
    )
    in_range = Window.partitionBy("range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    swept = swept.withColumn("last", F.last("opened", ignorenulls=True).over(in_range))
    # One row per range: the last rule opened in it, and before it (a rule opened in no range
    # of its own reaches the ranges after it this way).
    closing = swept.where("kind = 0").groupBy("range").agg(F.max("key").alias("closing"))
    carry_in = (
        swept.select("range").distinct()
        .join(closing, "range", "left")
        .withColumn(
            "carry_in",
            F.last("closing", ignorenulls=True).over(
                Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select("range", "carry_in")
    )
    placed = (
        swept.where("kind = 1")
        # One row per range: bounded by the input over RANGE_ROWS.
        .join(F.broadcast(carry_in), "range", "left")
        .withColumn("top", F.coalesce("last", "carry_in"))
        # The rule table is left to Spark's own size check; the fixed one has five rules.
        .join(rules.select(F.col("key").alias("top"), "stack"), "top", "left")
    )
    fitting = F.filter(
        F.coalesce("stack", F.array()),
        lambda r: F.startswith(F.col("key"), r["key"]) & F.startswith(F.col("path"), r["path"]),
    )
    # Longest first, then block, then the smaller rule text.
    ranked = F.array_sort(
        fitting,
        lambda a, b: F.when(a["length"] > b["length"], -1)
        .when(a["length"] < b["length"], 1)
        .when((a["verdict"] == "block") & (b["verdict"] != "block"), -1)
        .when((a["verdict"] != "block") & (b["verdict"] == "block"), 1)
        .when(a["rule"] < b["rule"], -1)
        .when(a["rule"] > b["rule"], 1)
        .otherwise(0),
    )
    best = F.get(ranked, 0)
    return placed.select(
        "page_id",
        "url",
        "host",
        "path",
        best["rule"].alias("rule"),
        F.coalesce(best["verdict"], F.lit(default)).alias("verdict"),
    )
