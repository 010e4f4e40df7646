"""Exact length histogram of encoded documents and every context limit's totals.

One pass encodes the whole texts; documents are summed up by encoded length inside
each task, so the shuffle carries one row for each length and task. Suffix sums over
the lengths then answer, for every context limit at once: documents and tokens that
fit, the tokens that remain after cutting at the limit, and any quantile.

The histogram has at most one row for each distinct length. Suffix sums are two-level
(sums of ranges of lengths, then within a range), so no task holds more than one range.

Null and empty texts have length 0 and count as documents. Empty table: no rows.
Extra columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import as_bytes, materialize, slices
from emberline.llm.tokens import VOCABULARY, chunk_ids

RANGE = 256


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found = chunk_ids(vocabulary), Counter()
        for batch in slices(batches, text):
            for value in as_bytes(batch, text):
                found[sum(map(len, map(ids.__getitem__, value.split()))) // 4] += 1
        yield pa.record_batch({"n_tokens": pa.array(list(found), pa.int64()), "n_docs": pa.array(list(found.values()), pa.int64())})

    # written, as every total reads it and texts are to be encoded once
    return materialize(docs.select(text).mapInArrow(counted, "n_tokens long, n_docs long")
                       .groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "length-histogram")


def context_totals(histogram: DataFrame) -> DataFrame:
    """For every occurring length taken as the context limit:

    limit, n_docs of just that length, docs_within / tokens_within (not longer),
    docs_over (longer), truncated_tokens (sum of min(length, limit)), lost_tokens and
    share_within (the quantile that the limit is). All sums are exact.
    """
    held = histogram.withColumn("range", F.floor(F.col("n_tokens") / RANGE)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    ranges = held.groupBy("range").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("tokens"))
    # a row for each range of lengths: at most the longest document's length / RANGE rows
    after = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    above = ranges.select("range", F.coalesce(F.sum("docs").over(after), F.lit(0)).alias("docs_above"),
                          F.coalesce(F.sum("tokens").over(after), F.lit(0)).alias("tokens_above"))
    whole = ranges.agg(F.sum("docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))
    later = Window.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    placed = (held.join(above, "range").crossJoin(F.broadcast(whole))
              .withColumn("docs_over", F.coalesce(F.sum("n_docs").over(later), F.lit(0)) + F.col("docs_above"))
              .withColumn("tokens_over", F.coalesce(F.sum("tokens").over(later), F.lit(0)) + F.col("tokens_above")))
    within = F.col("all_tokens") - F.col("tokens_over")
    truncated = within + F.col("n_tokens") * F.col("docs_over")
    return placed.select(
        F.col("n_tokens").alias("context_limit"), "n_docs",
        (F.col("all_docs") - F.col("docs_over")).alias("docs_within"), within.alias("tokens_within"), "docs_over",
        truncated.alias("truncated_tokens"), (F.col("all_tokens") - truncated).alias("lost_tokens"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("share_within"))


def totals_at(totals: DataFrame, limits: DataFrame) -> DataFrame:
    """Answers for any limits (column ``context_limit``), from the nearest occurring length below.

    docs_within, docs_over, tokens_within and truncated_tokens; limits below every
    length get zero documents within. ``limits`` is the caller's short list.
    """
    whole = totals.agg(F.max("docs_within").alias("all_docs"), F.max("tokens_within").alias("all_tokens"))
    asked = limits.select(F.col("context_limit").cast("long").alias("asked")).distinct()
    return (asked.join(totals, F.col("context_limit") <= F.col("asked"), "left")
            .groupBy("asked").agg(F.coalesce(F.max("docs_within"), F.lit(0)).alias("docs_within"),
                                  F.coalesce(F.max("tokens_within"), F.lit(0)).alias("tokens_within"))
            .crossJoin(F.broadcast(whole))
            .select(F.col("asked").alias("context_limit"), "docs_within", "tokens_within",
                    (F.col("all_docs") - F.col("docs_within")).alias("docs_over"),
                    (F.col("tokens_within") + F.col("asked") * (F.col("all_docs") - F.col("docs_within"))).alias("truncated_tokens")))


def quantiles(totals: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the documents does not exceed."""
    spark = totals.sparkSession
    asked = spark.createDataFrame([(float(s),) for s in shares], "share double")
    return (asked.join(totals, F.col("share_within") >= F.col("share"))
            .groupBy("share").agg(F.min("context_limit").alias("n_tokens")))
