"""Substring search over stored texts by a trigram posting table.

Built once: every text's distinct runs of three characters become postings (gram, id),
partitioned by a hash of the gram, and the rows are stored by a hash of their id. A search
for three characters or more reads the postings of its pattern's grams only, keeps the ids
that have them all, reads the partitions of these ids and tests the text itself; so what it
reads grows with the pattern's rarest grams, not with the table. Shorter patterns have no
gram and scan.

Texts are compared in lower case. Null texts match only the empty pattern, as the empty
text does. A repeated id is one posting and keeps its rows. Characters are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import broadcast_if_small

GRAM = 3
GRAM_PARTS, ROW_PARTS = 64, 64
#: Grams of a pattern that are intersected; the test of the text settles the rest.
MOST_GRAMS = 8


def grams_of(text: Column) -> Column:
    """The distinct runs of three characters of a text."""
    last = F.greatest(F.char_length(text) - (GRAM - 1), F.lit(0))
    places = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
    return F.when(last > 0, F.array_distinct(F.transform(places, lambda k: F.substr(text, k, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def _part(value: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(parts)).cast("int")


def build_index(rows: DataFrame, text: Column, path: str, key: str = "event_id") -> None:
    """Write rows with their text and its postings below ``path``."""
    held = rows.withColumn("_text", F.lower(F.coalesce(text, F.lit("")))).withColumn("_row_part", _part(F.col(key), ROW_PARTS))
    # a part of a common gram or many rows is split over several writers
    held.hint("rebalance", "_row_part").write.partitionBy("_row_part").parquet(f"{path}/rows")
    postings = held.select(key, "_row_part", F.explode(grams_of(F.col("_text"))).alias("gram")).distinct().withColumn("_gram_part", _part(F.col("gram"), GRAM_PARTS))
    (postings.hint("rebalance", "_gram_part").sortWithinPartitions("gram", key).write.partitionBy("_gram_part").parquet(f"{path}/postings"))


def pattern_grams(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """The grams of a pattern, spread over its length, with the part that holds each."""
    found = list(dict.fromkeys(pattern[k:k + GRAM] for k in range(len(pattern) - GRAM + 1)))
    step = max(1, -(-len(found) // MOST_GRAMS))
    wanted = found[::step]
    rows = spark.createDataFrame([(g,) for g in wanted], "gram string").select("gram", _part(F.col("gram"), GRAM_PARTS).alias("part")).collect()  # at most MOST_GRAMS
    return [(r["gram"], r["part"]) for r in rows]


def search(spark: SparkSession, path: str, pattern: str, key: str = "event_id") -> DataFrame:
    """Stored rows whose text contains the pattern, trimmed and in lower case."""
    wanted = pattern.strip().lower()
    rows = spark.read.parquet(f"{path}/rows")
    matches = F.col("_text").contains(wanted)
    if len(wanted) >= GRAM:
        grams = pattern_grams(spark, wanted)
        postings = spark.read.parquet(f"{path}/postings").filter(F.col("_gram_part").isin(sorted({p for _, p in grams})) & F.col("gram").isin([g for g, _ in grams]))
        ids = postings.groupBy(key, "_row_part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)).select(key, "_row_part")
        # the parts of the ids are known before the rows are read, so the others are not opened
        rows = rows.join(broadcast_if_small(ids), [key, "_row_part"], "left_semi")
    return rows.filter(matches).drop("_text", "_row_part")
