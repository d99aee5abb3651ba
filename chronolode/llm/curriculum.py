"""Mixing sources to target weights along a time-varying curriculum. Built-in expressions only.

Every source has a target (words the mix takes from it) and a weight schedule over training
time t in [0, 1]: ``target * (1 + slope * (2t - 1))``, whose integral over the whole training
is the target. Its cumulative demand ``D(t) = target * ((1 - slope) * t + slope * t^2)`` is
inverted: the words of a source, laid out pass after pass in an order given by the ids, get
the time at which the demand reaches them. Sorting all sources by that time gives the order
of training.

Defined results: a NULL text has size 0; a NULL source is a source of its own, last; rows of
size 0 take nothing and get no position; equal ids (also NULL ids) keep one order among rows
that differ in source or size, and rows equal in all three are interchangeable; an empty
table gives an empty plan. Columns of the input other than id, text and source do not matter
to the plan and are kept by ``training_order`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolode.llm.common import word_count

WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
# Slopes of the schedules, repeating over the sources: early, even, late.
SLOPES = (-0.5, 0.0, 0.5)
# Documents of a source are summed in blocks of their id digest; so many hex digits of it.
BLOCK_DIGITS = 4


def _cycle(rank: Column, values: tuple) -> Column:
    return F.element_at(
        F.array(*[F.lit(v) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int")
    )


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: words it has, weight, slope and target.

    Water filling in closed form: sources ordered by the level at which they are full
    (``MOST_PASSES`` times their words per weight); a source is full if the level that the
    rest of the demand gives to it and all later ones reaches its own. The windows here see
    one row per source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(ordered))
        .withColumn("weight", _cycle(F.col("rank"), WEIGHTS).cast("double"))
        .withColumn("slope", _cycle(F.col("rank"), SLOPES))
        .withColumn("most", MOST_PASSES * F.col("source_size"))
        .withColumn("level", F.col("most") / F.col("weight"))
        .withColumn(
            "left",
            F.sum("source_size").over(Window.partitionBy())
            - F.coalesce(
                F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .withColumn(
            "open",
            F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        )
        .withColumn("fair", F.col("left") / F.col("open"))
        .withColumn("place", F.row_number().over(by_level))
        # The first source that is not full sets the level of all from it on.
        .withColumn(
            "turn",
            F.min(F.when(F.col("level") > F.col("fair"), F.col("place"))).over(
                Window.partitionBy()
            ),
        )
        .withColumn(
            "water",
            F.max(F.when(F.col("place") == F.col("turn"), F.col("fair"))).over(
                Window.partitionBy()
            ),
        )
        .withColumn(
            "target",
            F.when(F.col("place") >= F.col("turn"), F.col("water") * F.col("weight")).otherwise(
                F.col("most").cast("double")
            ),
        )
        .select("source", "source_size", "slope", "target")
    )


def mixture(docs: DataFrame, carry: Column | None = None) -> DataFrame:
    """One row per document: size, its source's words and target, words taken, positions.

    A document is taken once per whole pass of its source and once more if the middle of its
    words lies inside the part of a pass that is left. ``positions`` holds the training time
    of each time it is taken. ``carry`` adds one more column of the caller's.
    """
    rows = docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"),
        *([carry.alias("carry")] if carry is not None else []),
    ).withColumn("block", F.substring("key", 1, BLOCK_DIGITS))
    # The source as a key that is never NULL: windows and joins by it share one shuffle of the
    # rows, which may carry texts.
    rows = rows.withColumn(
        "part", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    )
    # Running sums of a source that may hold most rows: over its blocks, then inside a block.
    blocks = rows.groupBy("source", "part", "block").agg(F.sum("size").alias("block_size"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn(
        "base", F.coalesce(F.sum("block_size").over(before), F.lit(0))
    ).join(
        source_targets(rows.select("source", "size")).withColumnRenamed("source", "of"),
        F.col("source").eqNullSafe(F.col("of")),
    ).select(
        "part", "block", "base", "source_size", "slope", "target",
    )
    inside = (
        Window.partitionBy("part", "block")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(blocks, ["part", "block"])
        .withColumn("middle", F.col("base") + F.col("inside") + F.col("size") / 2)
    )
    passes = F.when(F.col("size") == 0, F.lit(0)).otherwise(
        F.floor(F.col("target") / F.col("source_size"))
        + (
            F.col("middle")
            <= F.col("target")
            - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")
        ).cast("long")
    )
    passes = F.least(passes, F.lit(MOST_PASSES)).cast("int")

    def time_of(i: Column) -> Column:
        share = F.least(F.lit(1.0), (i * F.col("source_size") + F.col("middle")) / F.col("target"))
        slope = F.col("slope")
        # Root of slope * t^2 + (1 - slope) * t = share in [0, 1], without cancellation.
        return 2 * share / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share))

    return placed.withColumn("passes", passes).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("passes") * F.col("size")).alias("taken"),
        F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0), F.col("passes") - 1), time_of))
        .otherwise(F.array().cast("array<double>"))
        .alias("positions"),
        *(["carry"] if carry is not None else []),
    )


def first_taken_order(docs: DataFrame) -> DataFrame:
    """The rows of ``mixture`` in the order in which training first takes them.

    Range-partitioned and sorted as ``training_order`` is; ties are broken by document id,
    source and size. Rows that are never taken come last.
    """
    order = [F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id", "source", "size"]
    return mixture(docs).repartitionByRange(*order).sortWithinPartitions(*order)


def training_order(docs: DataFrame) -> DataFrame:
    """The mix itself: every time a document is taken, one row with its ``position``, in order.

    Rows are range-partitioned and sorted by position, so partition files in name order are
    the training order. Ties are broken by document id and pass. All columns of the input
    stay; ``position`` and ``pass`` come last (the input's own columns of these names, if
    any, give way).
    """
    own = [c for c in docs.columns if c not in ("position", "pass")]
    plan = mixture(docs, F.struct(*[F.col(f"`{c}`") for c in own]))
    return (
        plan.select("carry", F.posexplode("positions").alias("pass", "position"))
        .select("carry.*", "position", "pass")
        .repartitionByRange("position", "doc_id", "pass")
        .sortWithinPartitions("position", "doc_id", "pass")
    )
