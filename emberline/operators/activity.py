"""Activity of events by day as bit maps that batches add to.

A state row is one event and one span of 64 days: a bit for each day with a detection, and
the number of detections. States of disjoint batches are merged by ``bit_or`` and ``sum``,
both combinable, so that active days, the longest run of days and the count of an event
follow from the states alone; no member is read again, and a state is as long as the
calendar, not as the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.numeric import utc_day
from emberline.operators.ranking import rank_within

WORD_DAYS = 64


def _day_number(ts: Column) -> Column:
    return F.datediff(utc_day(ts), F.lit("1970-01-01").cast("date"))


def day_words(linked: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, word, bits, n): the state of some rows; rows without a time do not count."""
    day = _day_number(F.col("timestamp"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(day, F.lit(WORD_DAYS)))
    return (linked.filter(F.col("timestamp").isNotNull() & F.col(key).isNotNull()).select(key, F.floor(day / WORD_DAYS).cast("int").alias("word"), bit.alias("bit"))
            .groupBy(key, "word").agg(F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("n")))


def merged_words(states: DataFrame, key: str = "event_id") -> DataFrame:
    """States of disjoint rows as one; keys may have been joined in between."""
    return states.groupBy(key, "word").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))


def active_dates(states: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, day) for every day with a detection."""
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD_DAYS - 1)), lambda k: F.call_function("shiftright", F.col("bits"), k).bitwiseAND(F.lit(1).cast("long")) == 1)
    placed = states.select(key, "word", F.explode(places).alias("place"))
    return placed.select(key, F.date_add(F.lit("1970-01-01").cast("date"), F.col("word") * WORD_DAYS + F.col("place")).alias("day"))


def activity_of(states: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, detections, active_days, consecutive_active_days, first_day, last_day) from merged states."""
    counts = states.groupBy(key).agg(F.sum("n").alias("detections"), F.sum(F.bit_count("bits")).cast("long").alias("active_days"))
    numbered = rank_within(active_dates(states, key), [key], ["day"], largest=0)  # days of the calendar, not rows
    runs = (numbered.groupBy(key, F.date_sub(F.col("day"), F.col("rank").cast("int")).alias("island")).agg(F.count(F.lit(1)).alias("run"), F.min("day").alias("low"), F.max("day").alias("high"))
            .groupBy(key).agg(F.max("run").alias("consecutive_active_days"), F.min("low").alias("first_day"), F.max("high").alias("last_day")))
    return counts.join(runs, key).select(key, "detections", "active_days", "consecutive_active_days", "first_day", "last_day")


def daily_totals(rows: DataFrame) -> DataFrame:
    """(day, n) of some rows; totals of disjoint batches are merged by ``sum``."""
    return rows.filter("timestamp IS NOT NULL").groupBy(utc_day(F.col("timestamp")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
