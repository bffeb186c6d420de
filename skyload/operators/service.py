"""Service-request counts per flight, in total and by keyword category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyload.config import FLIGHT_KEY
from skyload.functions.columns import contains_any
from skyload.operators.spread import spread_join

LOCATOR = "record_locator"
REQUEST = "special_service_request"
FLIGHT_NUMBER = "flight_number"
COUNTS = ("ssr_count", "ssr_mobility_count", "ssr_special_handling_count")


def booking_keys(bookings: DataFrame, key: Sequence[str] = FLIGHT_KEY) -> DataFrame:
    """Distinct (flight, booking) pairs; pairs with a missing part can match nothing and are left out."""
    return bookings.select(*key, LOCATOR).dropna().distinct()


def request_counts(remarks: DataFrame, by: Sequence[str], mobility: Sequence[str], special: Sequence[str]) -> DataFrame:
    """Remarks and keyword matches per booking."""

    def matches(words: Sequence[str]) -> Column:
        if REQUEST not in remarks.columns:
            return F.lit(0).cast("bigint")
        return F.count_if(contains_any(F.col(REQUEST), words))

    return (
        remarks.dropna(subset=list(by))
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("ssr_count"),
            matches(mobility).alias("ssr_mobility_count"),
            matches(special).alias("ssr_special_handling_count"),
        )
    )


def service_features(
    bookings: DataFrame,
    remarks: DataFrame,
    key: Sequence[str] = FLIGHT_KEY,
    mobility: Sequence[str] = ("WCHR", "WCHS", "WCHC", "MOBILITY"),
    special: Sequence[str] = ("PET", "UMNR", "MEDA", "STRETCHER"),
    mode: str = "locator",
    limit: int | None = None,
) -> DataFrame:
    """One row per flight that has a remark.

    ``locator``: every remark of a booking counts once on each flight of the booking.
    ``locator_flight``: only on the flight whose number the remark names.
    ``fanout``: as ``locator``, times the number of the booking's flights.

    Remarks are counted per booking before the join, so a booking meets one row, not its remarks.
    """
    pairs = booking_keys(bookings, key)
    if mode == "locator_flight":
        if FLIGHT_NUMBER not in key or FLIGHT_NUMBER not in remarks.columns:
            raise ValueError("mode locator_flight needs flight_number in the flight key and in the remarks")
        kind = bookings.schema[FLIGHT_NUMBER].dataType
        by = [LOCATOR, FLIGHT_NUMBER]
        remarks = remarks.withColumn(FLIGHT_NUMBER, F.col(FLIGHT_NUMBER).try_cast(kind))
    elif mode in ("locator", "fanout"):
        by = [LOCATOR]
    else:
        raise ValueError(f"unknown service request mode: {mode}")

    counts = request_counts(remarks, by, mobility, special)
    if mode == "fanout":
        flights_of_booking = pairs.groupBy(LOCATOR).agg(F.count(F.lit(1)).alias("_flights"))
        counts = counts.join(flights_of_booking, LOCATOR).select(
            LOCATOR, *[(F.col(name) * F.col("_flights")).alias(name) for name in COUNTS]
        )
    joined = spread_join(pairs, counts, by, how="inner", sizes=bookings, limit=limit)
    return joined.groupBy(*key).agg(*[F.sum(name).alias(name) for name in COUNTS])
