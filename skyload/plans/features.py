"""All features of a flight in one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyload.config import DAY, DEPARTURE, Settings
from skyload.functions.columns import or_zero
from skyload.operators.bags import bag_features
from skyload.operators.context import (
    with_aircraft,
    with_bags_per_seat,
    with_country,
    with_slot_congestion,
    with_weather,
)
from skyload.operators.history import with_volatility
from skyload.operators.passengers import passenger_features, with_load
from skyload.operators.service import service_features
from skyload.operators.spread import attach_all
from skyload.operators.staging import fit_generated_code
from skyload.operators.turn import with_extra_features, with_turn_features
from skyload.sources.tables import Inputs

COUNTS = (
    "children",
    "stroller_users",
    "lap_children",
    "ssr_count",
    "ssr_mobility_count",
    "ssr_special_handling_count",
    "hot_transfer_count",
    "total_transfer_bags",
    "total_bags",
)
RATIOS = ("transfer_ratio", "bag_issue_lead_mean", "bag_late_issue_ratio")


def flight_aggregates(inputs: Inputs, settings: Settings, day: str = DAY, limit: int | None = None) -> list[DataFrame]:
    """Passenger, bag and service features, each one row per flight key."""
    key = list(settings.key)
    passengers = passenger_features(inputs.bookings, key, settings.late_booking_days, day)
    bags = bag_features(inputs.bags, inputs.flights, key, limit=limit)
    requests = service_features(
        inputs.bookings, inputs.remarks, key, settings.mobility_keywords, settings.special_keywords, settings.ssr_mode, limit
    )
    return [passengers, bags, requests]


def with_interactions(master: DataFrame) -> DataFrame:
    pressure = F.col("ground_time_pressure")
    return master.withColumns(
        {
            "transfer_ground_interaction": F.col("transfer_ratio") * pressure,
            "load_pressure_interaction": F.col("load_factor") * pressure,
        }
    )


def build_features(
    inputs: Inputs,
    settings: Settings | None = None,
    ties: Sequence[str] = (),
    per_date_slots: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Flights with every feature, one row per input flight.

    ``ties`` orders flights of the same number and day, after the flight key.
    """
    settings = settings or Settings()
    fit_generated_code(inputs.flights.sparkSession)
    key = list(settings.key)
    flights = with_weather(inputs.flights, inputs.weather, limit=limit) if inputs.weather is not None else inputs.flights
    aggregates = flight_aggregates(inputs, settings, limit=limit)
    identity = [*key, *([DEPARTURE] if DEPARTURE in flights.columns else [])]
    master = attach_all(flights, aggregates, key, sizes=inputs.flights, by=identity, limit=limit)
    master = master.fillna(0, subset=[*COUNTS, *RATIOS])
    master = with_load(with_turn_features(master))
    master = with_bags_per_seat(with_aircraft(master, settings.widebody_seats))
    master = with_country(master, inputs.airports, settings.home_country, inputs.flights)
    master = with_slot_congestion(master, per_date_slots, source=inputs.flights, limit=limit)
    order = [name for name in dict.fromkeys([*key, *ties]) if name not in (DAY, "flight_number")]
    master = with_volatility(
        master, window=settings.volatility_window, ties=order, sizes=inputs.flights, limit=limit
    )
    master = with_interactions(master)
    if "weather_severity_index" in master.columns:
        severity = or_zero(F.col("weather_severity_index")).cast("double")
    else:
        severity = F.lit(0.0)
    return master.withColumn("weather_severity_index", severity)


def build_extended_features(inputs: Inputs, settings: Settings | None = None, **options) -> DataFrame:
    """:func:`build_features` with the exploratory features added."""
    return with_extra_features(build_features(inputs, settings, **options))
