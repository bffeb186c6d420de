"""Ground-time features and measures of a flight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyload.config import ACTUAL_DEPARTURE, ARRIVAL, DEPARTURE
from skyload.functions.columns import flag, minutes_between, or_zero, ratio, shortfall

MINIMUM, SCHEDULED, ACTUAL = "minimum_turn_minutes", "scheduled_ground_time_minutes", "actual_ground_time_minutes"


def with_turn_features(flights: DataFrame) -> DataFrame:
    """Minutes missing against the minimum turn, scheduled and actual, and the actual share of it."""
    have = set(flights.columns)
    zero, least = F.lit(0), F.col(MINIMUM)
    pressure = shortfall(least, F.col(SCHEDULED)) if {MINIMUM, SCHEDULED} <= have else zero
    actual = {MINIMUM, ACTUAL} <= have
    return flights.withColumns(
        {
            "ground_time_pressure": pressure,
            "actual_turn_deficit": shortfall(least, F.col(ACTUAL)) if actual else zero,
            "turn_deficit_ratio": or_zero(ratio(F.col(ACTUAL), least)) if actual else F.lit(0.0),
        }
    )


def with_delay(flights: DataFrame) -> DataFrame:
    """Departure delay in minutes; null when not known."""
    known = {DEPARTURE, ACTUAL_DEPARTURE} <= set(flights.columns)
    delay = minutes_between(F.col(DEPARTURE), F.col(ACTUAL_DEPARTURE)) if known else F.lit(None).cast("double")
    return flights.withColumn("dep_delay_minutes", delay)


def with_ground_bands(flights: DataFrame) -> DataFrame:
    """Scheduled ground time over the minimum, and flags for none and for up to five minutes."""
    if not {MINIMUM, SCHEDULED} <= set(flights.columns):
        return flights
    delta = F.col(SCHEDULED) - F.col(MINIMUM)
    return flights.withColumns(
        {
            "ground_time_delta": delta,
            "at_or_below_min_turn": flag(delta <= 0),
            "within_5_min_above_min": flag((delta > 0) & (delta <= 5)),
        }
    )


def with_extra_features(master: DataFrame) -> DataFrame:
    """Exploratory features: buffer, block time, carrier, size band, per-passenger ratios, pressure."""
    have = set(master.columns)
    added = {}
    if {MINIMUM, SCHEDULED} <= have:
        added["turn_buffer_ratio"] = ratio(F.col(SCHEDULED), F.col(MINIMUM))
    if {DEPARTURE, ARRIVAL} <= have:
        block = minutes_between(F.col(DEPARTURE), F.col(ARRIVAL))
        added["scheduled_block_minutes"] = block
        added["long_haul_indicator"] = flag(block >= 360)
    else:
        added["scheduled_block_minutes"] = F.lit(None).cast("double")
        added["long_haul_indicator"] = F.lit(0)
    added["is_express"] = flag(F.lower("carrier") == "express") if "carrier" in have else F.lit(0)
    if "total_seats" in have:
        added["aircraft_size_category"] = size_band(F.col("total_seats"))

    def present(name: str):
        return F.col(name) if name in have else F.lit(0)

    if "total_pax" in have:
        added["bag_intensity"] = ratio(present("total_bags"), F.col("total_pax"))
        added["ssr_per_pax"] = ratio(present("ssr_count"), F.col("total_pax"))
    added["pressure_index"] = (
        or_zero(present("ground_time_pressure")).cast("double") * 0.6
        + or_zero(present("transfer_ratio")).cast("double") * 0.2
        + or_zero(present("ssr_count")).cast("double") * 0.2
    )
    return master.withColumns(added)


def size_band(seats):
    """Bands close at 70, 150 and 250 seats; none below 0."""
    return (
        F.when(seats < 0, None)
        .when(seats <= 70, "Regional")
        .when(seats <= 150, "Narrowbody")
        .when(seats <= 250, "Large Narrowbody")
        .when(seats > 250, "Widebody")
    )
