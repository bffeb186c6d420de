"""Tolerant parsing of text columns: a bad value becomes null and never fails the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "missing" in delimited files.
NULL_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

OFFSET_AT_END = r"(Z|[+-]\d{2}:?\d{2})\s*$"


def text_or_null(value: Column) -> Column:
    """The text, or null if it says "missing", white space around it not counted."""
    return F.when(~F.trim(value).isin(*NULL_TEXTS), value)


def parse_timestamp(value: Column) -> Column:
    """Text to wall-clock timestamp from ISO or M/D/YYYY [H:MM[:SS]]; an offset in the text is dropped and its wall clock kept."""
    year_first = F.regexp_replace(F.trim(value), r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2")
    return year_first.try_cast("timestamp_ntz")


def parse_utc_timestamp(value: Column) -> Column:
    """Text to timestamp; a value with an offset is moved to UTC, one without is kept as it is."""
    text = F.trim(value)
    zoned = text.try_cast("timestamp").cast("timestamp_ntz")
    in_utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), zoned)
    return F.when(text.rlike(OFFSET_AT_END) & text.contains(":"), in_utc).otherwise(parse_timestamp(text))


def parse_date(value: Column) -> Column:
    """Text to date from YYYY-MM-DD, M/D/YYYY, or any timestamp in these styles."""
    text = F.trim(value)
    return F.coalesce(
        F.try_to_date(text, "yyyy-MM-dd"),
        parse_timestamp(text).cast("date"),
    )


def parse_integer(value: Column, kind: str = "bigint") -> Column:
    """Text to integer; '12.0' counts as 12."""
    text = F.trim(value)
    return F.coalesce(text.try_cast(kind), finite(text.try_cast("double")).try_cast(kind))


def finite(value: Column) -> Column:
    """A number as it is, but null for NaN and the infinities, which no sum or rank survives."""
    return F.when(F.abs(value) < float("inf"), value)


def parse_as(value: Column, kind: str) -> Column:
    """Parse a text column into the kind a table layout names."""
    if kind == "date":
        return parse_date(value)
    if kind == "timestamp":
        return parse_timestamp(value)
    if kind == "timestamp_utc":
        return parse_utc_timestamp(value)
    if kind in ("int", "bigint"):
        return parse_integer(value, kind)
    if kind == "double":
        return finite(F.trim(value).try_cast("double"))
    return value
