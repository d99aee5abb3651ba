"""Token counts as an exact length histogram.

Documents are encoded whole with a public tokenizer (its files are read from ``folder``, a
parameter) in Arrow batches and aggregated by encoded length. Sums over the suffix of the
histogram answer, for every context limit, how many documents are longer, how many tokens
they hold, what is left after truncation, and every quantile.

Defined results: NULL and empty texts have length 0; an empty table gives no row.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolode.llm.common import map_arrow, with_fields

FOLDER = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
# Word pattern of the public byte-level vocabularies (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Lengths per block of the two-level suffix sums.
BLOCK = 1024


@functools.lru_cache(maxsize=1)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, folder: str = FOLDER, ranks: str = RANKS) -> DataFrame:
    """``n_tokens`` of every row (and its ``doc_id``, if the input has one)."""
    path = f"{folder}/{ranks}"
    ids = ["doc_id"] if "doc_id" in docs.columns else []

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = _encoding(path).encode_ordinary
        n = np.fromiter((len(encode(t)) for t in batch.column("text").to_pylist()), np.int64)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ids), pa.array(n)], names=[*ids, "n_tokens"]
        )

    return map_arrow(docs.select(*ids, "text"), step, with_fields(docs, ids, "n_tokens long"))


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per length that occurs, with its suffix sums.

    ``n_docs`` documents have exactly ``n_tokens`` tokens; ``docs_from`` and ``tokens_from``
    count the documents of at least that length and their tokens; ``kept_at_limit`` is what
    all documents keep if each is cut at ``n_tokens``, ``lost_at_limit`` what they lose;
    ``share_within`` is the share of documents of at most this length, so the q-quantile is
    the first row whose share is at least q. Limits between two lengths follow from the next
    longer row: ``tokens_below + limit * docs_from``.

    The histogram is summed over blocks of lengths first and inside blocks then, so no window
    sees more than one block or one row per block.
    """
    histogram = (
        lengths.groupBy("n_tokens")
        .agg(F.count(F.lit(1)).alias("n_docs"))
        .withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
        .withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    )
    after = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = (
        histogram.groupBy(F.col("block").alias("b"))
        .agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
        .select(
            "b",
            F.coalesce(F.sum("d").over(after), F.lit(0)).alias("later_docs"),
            F.coalesce(F.sum("t").over(after), F.lit(0)).alias("later_tokens"),
            F.sum("d").over(everything).alias("all_docs"),
            F.sum("t").over(everything).alias("all_tokens"),
        )
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    return (
        histogram.withColumn("d", F.sum("n_docs").over(inside))
        .withColumn("t", F.sum("tokens").over(inside))
        .join(blocks, F.col("block") == F.col("b"))
        .withColumn("docs_from", F.col("d") + F.col("later_docs"))
        .withColumn("tokens_from", F.col("t") + F.col("later_tokens"))
        .withColumn("tokens_below", F.col("all_tokens") - F.col("tokens_from"))
        .withColumn(
            "kept_at_limit", F.col("tokens_below") + F.col("n_tokens") * F.col("docs_from")
        )
        .select(
            "n_tokens",
            "n_docs",
            "docs_from",
            "tokens_from",
            "tokens_below",
            "kept_at_limit",
            (F.col("all_tokens") - F.col("kept_at_limit")).alias("lost_at_limit"),
            ((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias(
                "share_within"
            ),
        )
    )


def answers(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """Kept tokens and cut documents for each row of ``limits(context)``; small tables both.

    The row of the first length beyond the limit holds the answer; a limit no document
    exceeds keeps everything.
    """
    found = limits.join(
        histogram.select("n_tokens", "docs_from", "tokens_below"),
        F.col("n_tokens") > F.col("context"),
        "left",
    ).groupBy("context").agg(
        F.min_by(F.struct("docs_from", "tokens_below"), "n_tokens").alias("next")
    )
    total = histogram.agg(
        F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("all_tokens")
    )
    return found.join(total, F.lit(True)).select(
        "context",
        F.coalesce(F.col("next.docs_from"), F.lit(0)).alias("cut_docs"),
        F.coalesce(
            F.col("next.tokens_below") + F.col("context") * F.col("next.docs_from"),
            F.col("all_tokens"),
        ).alias("kept_tokens"),
    )
