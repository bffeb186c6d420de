"""Column expressions shared by the operators. All run inside generated JVM code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole where whole is positive, else null."""
    return F.when(whole > 0, part / whole)


def flag(condition: Column) -> Column:
    """1 where the condition is true, 0 where it is false or unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def shortfall(needed: Column, given: Column) -> Column:
    """needed - given, never negative, 0 when either is missing."""
    return F.coalesce(F.greatest(needed - given, F.lit(0)), F.lit(0))


def seconds_between(start: Column, end: Column) -> Column:
    """Wall-clock seconds from start to end (fractional), whatever the session time zone."""
    gap = end.cast("timestamp_ntz") - start.cast("timestamp_ntz")
    return gap.cast("interval second").cast("decimal(20,6)").cast("double")


def minutes_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / 60.0


def wall_micros(moment: Column) -> Column:
    """Microseconds on the wall clock since 1970, whatever the session time zone."""
    gap = moment.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (gap.cast("interval second").cast("decimal(20,6)") * F.lit(1_000_000)).cast("bigint")


def whole_days_between(start: Column, end: Column) -> Column:
    """Complete days from start to end, rounded down."""
    return F.floor(seconds_between(start, end) / 86400.0)


def hour_floor(moment: Column) -> Column:
    """Wall-clock hour a moment falls in, whatever the session time zone."""
    past = F.make_dt_interval(F.lit(0), F.lit(0), F.minute(moment), F.extract(F.lit("SECOND"), moment))
    return moment - past


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True when the upper-cased text holds one of the words anywhere; missing text holds none."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for word in words:
        found = found | F.contains(upper, F.lit(word.upper()))
    return found


def day_number(day: Column) -> Column:
    """Integer day usable as a join and range-frame key; a missing day gets its own number."""
    return F.coalesce(F.unix_date(day.cast("date")), F.lit(-10_000_000))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are known; null when either does not vary."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_samp(F.when(both, x)) * F.stddev_samp(F.when(both, y))
    return F.covar_samp(x, y) / F.nullif(spread, F.lit(0.0))


def double_order(value: Column) -> Column:
    """A bigint per double in the same order, equal only for equal doubles; NaN comes last, null stays.

    It is the double's 64 bits read as a number, with the sign of x: with ``2^e`` the largest power of two not above ``|x|``,
    ``(e + 1023) 2^52 + (|x| / 2^e - 1) 2^52``, and ``|x| 2^1074`` below ``2^-1022``. All steps are exact.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    over, under = size >= F.pow(F.lit(2.0), guess + 1), size < F.pow(F.lit(2.0), guess)
    exponent = F.when(over, guess + 1).when(under, guess - 1).otherwise(guess)
    step = F.lit(1 << 52)
    fraction = (size / F.pow(F.lit(2.0), exponent) - 1) * F.lit(2.0**52)
    number = (exponent + 1023).cast("bigint") * step + fraction.cast("bigint")
    small = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint")
    sized = F.when(size < F.lit(2.0**-1022), small).when(size == float("inf"), F.lit(2047) * step).otherwise(number)
    return F.when(value.isNull(), F.lit(None).cast("bigint")).when(F.isnan(value), F.lit(2047) * step + 1).when(value < 0, -sized).otherwise(sized)


def first_present(columns: Iterable[str], candidates: Iterable[str]) -> str | None:
    """The first candidate the table has."""
    have = set(columns)
    return next((name for name in candidates if name in have), None)
