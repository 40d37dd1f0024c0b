"""Exact token-length histogram and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, slices, small_batches, stash, token_ids

#: Lengths summed as one block: the running sums go over blocks first, then within each.
BLOCK = 256


def encoded_lengths(docs: DataFrame, text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """(length, n) pairs, counted within each task: the number of texts of each encoded length.

    Null and empty texts have length 0. Texts are encoded whole. Other columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen = token_ids(tokenizer_path), {}
        for b in slices(batches):
            for text in column(b, "t"):
                n = len(ids.of(text)) // 4
                seen[n] = seen.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["length", "n"])

    return small_batches(docs).select(F.col(text_col).alias("t")).mapInArrow(run, "length long, n long")


def length_histogram(docs: DataFrame, text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """One row per encoded length that occurs: length, n_docs, n_tokens. Empty input, no rows."""
    return (
        encoded_lengths(docs, text_col, tokenizer_path)
        .groupBy("length")
        .agg(F.sum("n").alias("n_docs"))
        .withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    )


def limit_answers(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as context limit: suffix sums and what follows from them.

    docs_from, tokens_from: documents and tokens of that length or more; truncated_tokens: tokens left when each
    document is cut to the limit; docs_cut: documents that the limit cuts; quantile: share of documents up to it.
    Sums run over blocks of lengths, then inside each block, so no task sees more than a block's lengths or all blocks.
    """
    histogram = stash(histogram, "histogram")  # read twice below
    cut = histogram.withColumn("block", F.floor(F.col("length") / BLOCK))
    later = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    blocks = cut.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("n_tokens").alias("bt"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("bd").over(every).alias("all_docs"),
        F.sum("bt").over(every).alias("all_tokens"),
    )
    down = W.partitionBy("block").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, 0)
    out = cut.join(blocks, "block").select(
        "length",
        "n_docs",
        "n_tokens",
        (F.sum("n_docs").over(down) + F.col("later_docs")).alias("docs_from"),
        (F.sum("n_tokens").over(down) + F.col("later_tokens")).alias("tokens_from"),
        "all_docs",
        "all_tokens",
    )
    return out.select(
        "length",
        "n_docs",
        "n_tokens",
        "docs_from",
        "tokens_from",
        (F.col("all_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_tokens"),
        (F.col("docs_from") - F.col("n_docs")).alias("docs_cut"),
        ((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Exact totals for any limits, whether such a length occurs or not: context_limit, n_docs, truncated_tokens, docs_cut."""
    at = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    h, lim = F.col("length"), F.col("context_limit")
    return (
        histogram.withColumn("context_limit", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
        .groupBy("context_limit")
        .agg(F.sum("n_docs").alias("n_docs"), F.sum(F.least(h, lim) * F.col("n_docs")).alias("truncated_tokens"), F.sum(F.when(h > lim, F.col("n_docs")).otherwise(0)).alias("docs_cut"))
        .join(at, "context_limit", "right")
    )


def length_quantile(answers: DataFrame, q: float) -> DataFrame:
    """The smallest length whose quantile is q or more, one row: length (null without documents)."""
    return answers.filter(F.col("quantile") >= q).agg(F.min("length").alias("length"))
