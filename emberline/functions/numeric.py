"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_CHARACTERS = "0123456789+-.eE"


def grid_round(value: Column, digits: int) -> Column:
    """Half-up rounding in plain double arithmetic, for keys made of raw inputs."""
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + F.lit(0.5)) / scale


def display_round(value: Column, digits: int) -> Column:
    """Half-up rounding for aggregates.

    The nudge of a hundred-thousandth of the last digit sends every decimal tie upwards,
    so a mean does not depend on the order in which partial sums were merged.
    """
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + F.lit(0.50001)) / scale


def exact_mean(value: str) -> Column:
    """Mean of a column of degrees whose rows are summed as decimals of nine places.

    The sum of whole billionths is the same in any order of the rows, so a mean that lies
    on a bound is the bound itself, and not a little more or less from run to run.
    """
    exact = F.col(value).try_cast("decimal(18,9)")
    return F.sum(exact).cast("double") / F.count(exact)


def plain_number(trimmed: Column) -> Column:
    """Trimmed text to double or null; refuses suffixed forms such as ``1d``.

    The character test keeps letters away from the cast: it is cheaper than a
    regular expression and spares the cast its exceptions.
    """
    return F.when(F.translate(trimmed, NUMBER_CHARACTERS, "") == F.lit(""), trimmed).try_cast("double")


def finite_number(text: Column) -> Column:
    """Text to finite double or null."""
    number = plain_number(F.trim(text))
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def clean_double(value: Column) -> Column:
    """Drop NaN and infinities from a double column."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3_600_000_000.0)


def utc_day(ts: Column) -> Column:
    return F.to_date(ts)
