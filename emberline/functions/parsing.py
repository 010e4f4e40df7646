"""Raw text fields of a detection feed as typed columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.numeric import finite_number, plain_number

# Texts that stand for a missing measurement.
MISSING_TOKENS = ("", "-", "na", "n/a", "null")
MISSING_CONFIDENCE_TOKENS = ("", "-", "unknown", "na", "n/a", "null")

# Confidence letters, their score and their category.
CONFIDENCE_SCORES = {"h": 100.0, "n": 50.0, "l": 0.0}
CONFIDENCE_CATEGORIES = {"h": "high", "n": "nominal", "l": "low"}

# Brightness columns in the order of preference on the ingest path.
BRIGHTNESS_FIELDS = ("bright_ti4", "brightness", "brightness_temperature", "bright_t31")
# The same for row normalization, where an explicit intensity wins.
NORMALIZE_BRIGHTNESS_FIELDS = ("intensity", "bright_ti4", "brightness_temperature", "brightness", "bright_t31")

NOT_FINITE = r"^[+-]?(nan|inf|infinity)$"
SPACED_DATETIME = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?$"
ISO_DATETIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?$"


def blank_to_null(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed != F.lit(""), trimmed)


def first_present(columns: Sequence[Column]) -> Column:
    """First value that is not blank."""
    return F.coalesce(*(blank_to_null(c) for c in columns))


def _digits_only(text: Column) -> Column:
    return F.translate(text, "0123456789", "") == F.lit("")


def _joined(text: Column, mark: str, *cuts: tuple[int, int]) -> Column:
    parts = [text.substr(start, length) for start, length in cuts]
    return F.concat_ws(mark, *parts)


def _clock(text: Column) -> Column:
    """Up to four digits as left-padded ``HHMM`` (none: midnight), six as ``HHMMSS``."""
    padded = F.rpad(F.when(F.length(text) <= 4, F.lpad(text, 4, "0")).when(F.length(text) == 6, text), 6, "0")
    return F.when(_digits_only(text), _joined(padded, ":", (1, 2), (3, 2), (5, 2)))


def _date(text: Column) -> Column:
    """``YYYY-MM-DD`` or ``YYYYMMDD``, else null."""
    dashed = (F.length(text) == 10) & (F.translate(text, "0123456789", "") == F.lit("--")) & (
        text.substr(5, 1) == F.lit("-")) & (text.substr(8, 1) == F.lit("-"))
    return (F.when(dashed, text)
            .when((F.length(text) == 8) & _digits_only(text), _joined(text, "-", (1, 4), (5, 2), (7, 2))))


def acquisition_time(date: Column, time: Column) -> Column:
    """Feed date and time as a UTC timestamp; null when either is not valid."""
    day = F.trim(F.coalesce(date, F.lit("")))
    clock = F.trim(F.coalesce(time, F.lit("")))
    whole = F.when(day.rlike(SPACED_DATETIME), day).otherwise(F.concat(_date(day), F.lit(" "), _clock(clock)))
    return whole.try_cast("timestamp")


def flexible_time(date: Column, time: Column) -> Column:
    """As ``acquisition_time`` and also ISO text with ``T`` and an offset."""
    day = F.trim(F.coalesce(date, F.lit("")))
    return F.when(day.rlike(ISO_DATETIME), day.try_cast("timestamp")).otherwise(acquisition_time(date, time))


def confidence_score(text: Column) -> Column:
    """Letters become 100/50/0, numbers stay when they lie in [0, 100]."""
    key = F.lower(F.trim(text))
    number = finite_number(key)
    score = F.when(number.between(F.lit(0.0), F.lit(100.0)), number)
    for letter, value in CONFIDENCE_SCORES.items():
        score = F.when(key == F.lit(letter), F.lit(value)).otherwise(score)
    return score


def confidence_percent(text: Column) -> Column:
    """Genuine percentages only; letters are categories, not numbers."""
    number = finite_number(text)
    return F.when(number.between(F.lit(0.0), F.lit(100.0)), number)


def confidence_category(text: Column) -> Column:
    key = F.lower(F.trim(text))
    branches = F.when(F.lit(False), F.lit(None).cast("string"))
    for letter, name in CONFIDENCE_CATEGORIES.items():
        branches = branches.when(key == F.lit(letter), F.lit(name))
    return branches


def present_measurement(columns: Sequence[Column]) -> Column:
    """First text that is not one of the missing tokens."""
    return F.coalesce(*(F.when(~F.lower(F.trim(c)).isin(*MISSING_TOKENS), F.trim(c)) for c in columns))


def _value(number: Column, low: float, high: float) -> Column:
    return F.when(number.between(F.lit(low), F.lit(high)), number)


def _error(text: Column, number: Column, value: Column) -> Column:
    return (F.when(text.isNull() | value.isNotNull(), F.lit(None).cast("string"))
            .when(number.isNotNull() | F.lower(text).rlike(NOT_FINITE), F.lit("OUT_OF_RANGE"))
            .otherwise(F.lit("MALFORMED")))


def measurement(columns: Sequence[Column], low: float, high: float) -> Column:
    """struct(value, error): error is MALFORMED, OUT_OF_RANGE or null; both null when missing."""
    text = present_measurement(columns)
    number = finite_number(text)
    value = _value(number, low, high)
    return F.struct(value.alias("value"), _error(text, number, value).alias("error"))


def with_measurements(df: DataFrame, fields: dict[str, tuple[Sequence[Column], float, float]]) -> DataFrame:
    """Add ``<name>_value`` and ``<name>_error`` per field.

    Texts, numbers, values and errors are separate projections of flat columns:
    the optimizer then repeats no parsing expression, and the generated code
    grows only linearly with the number of fields.
    """
    texts = df.select("*", *(present_measurement(columns).alias(f"_t_{name}") for name, (columns, _, _) in fields.items()))
    numbers = texts.select("*", *(plain_number(F.col(f"_t_{name}")).alias(f"_n_{name}") for name in fields))
    values = numbers.select("*", *(_value(F.col(f"_n_{name}"), low, high).alias(f"{name}_value") for name, (_, low, high) in fields.items()))
    return values.select(*df.columns, *(f"{name}_value" for name in fields), *(
        _error(F.col(f"_t_{name}"), F.col(f"_n_{name}"), F.col(f"{name}_value")).alias(f"{name}_error") for name in fields))


def metadata_number(metadata: Column, key: str) -> Column:
    """A number from JSON metadata, top level first, then one level down."""
    text = F.coalesce(F.get_json_object(metadata, f"$.{key}"), F.get_json_object(metadata, f"$.metadata.{key}"))
    return finite_number(text)


def metadata_text(metadata: Column, key: str) -> Column:
    return F.coalesce(F.get_json_object(metadata, f"$.{key}"), F.get_json_object(metadata, f"$.metadata.{key}"))
