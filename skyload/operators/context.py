"""Features from a flight's surroundings: destination country, aircraft, slot, weather."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyload.config import DAY, DEPARTURE, DESTINATION, ORIGIN
from skyload.functions.columns import flag, hour_floor, or_zero, ratio
from skyload.operators.spread import lookup_join
from skyload.operators.staging import stage

# Fixed value: fleet names of wide-body aircraft.
WIDEBODY_FLEETS = "(?i)767|777|787|330|350"


def with_country(
    flights: DataFrame, airports: DataFrame, home: str = "US", sizes: DataFrame | None = None, small: int | None = None
) -> DataFrame:
    """Country of the arrival airport; anything but the home country, unknown included, is international.

    A code listed with several countries has the first of them by name, so that no flight is counted twice.
    """
    known = airports.where("airport_iata_code IS NOT NULL").groupBy("airport_iata_code")
    pairs = known.agg(F.min("iso_country_code").alias("iso_country_code"))
    arrivals = stage(pairs.withColumn(DESTINATION, F.col("airport_iata_code")))
    joined = lookup_join(flights, arrivals, [DESTINATION], sizes=sizes, small=small)
    return joined.withColumn("is_international", (~F.col("iso_country_code").eqNullSafe(home)).cast("int"))


def with_aircraft(flights: DataFrame, widebody_seats: int = 250) -> DataFrame:
    have = set(flights.columns)
    many = F.col("total_seats") >= widebody_seats if "total_seats" in have else F.lit(False)
    named = F.col("fleet_type").rlike(WIDEBODY_FLEETS) if "fleet_type" in have else F.lit(False)
    wide = F.coalesce(many, F.lit(False)) | F.coalesce(named, F.lit(False))
    return flights.withColumn("widebody_flag", wide.cast("int"))


def with_bags_per_seat(master: DataFrame) -> DataFrame:
    return master.withColumn("bag_per_seat_ratio", or_zero(ratio(or_zero(F.col("total_bags")), F.col("total_seats"))))


def slot_counts(flights: DataFrame, per_date: bool = False, departure: str = DEPARTURE) -> DataFrame:
    """Departures per station and hour of day, over all dates or for each."""
    by = [F.col(ORIGIN), F.hour(departure).alias("dep_hour"), *([F.col(DAY)] if per_date else [])]
    known = F.col(ORIGIN).isNotNull() & F.col(departure).isNotNull()
    return flights.where(known).groupBy(*by).agg(F.count(F.lit(1)).alias("slot_congestion_count"))


def with_slot_congestion(
    flights: DataFrame,
    per_date: bool = False,
    departure: str = DEPARTURE,
    source: DataFrame | None = None,
    limit: int | None = None,
    small: int | None = None,
) -> DataFrame:
    """Attach the hour and its slot count. Slots are counted first, so no task ever holds a whole busy slot."""
    if not {ORIGIN, departure} <= set(flights.columns):
        return flights.withColumn("slot_congestion_count", F.lit(0).cast("bigint"))
    counts = slot_counts(flights if source is None else source, per_date, departure)
    hours = flights.withColumn("dep_hour", F.hour(departure))
    counts = stage(counts)
    keys = [ORIGIN, "dep_hour", *([DAY] if per_date else [])]
    rows = counts.withColumn("_flights", F.col("slot_congestion_count"))
    return lookup_join(hours, rows, keys, rows="_flights", by=[departure, *keys], limit=limit, small=small)


def hourly_weather(weather: DataFrame) -> DataFrame:
    """Mean severity per station and hour."""
    return (
        weather.dropna(subset=["station_code", "observation_time"])
        .groupBy(
            F.col("station_code").alias(ORIGIN),
            hour_floor(F.col("observation_time").cast("timestamp_ntz")).alias("weather_hour"),
        )
        .agg(F.avg("weather_severity_index").alias("weather_severity_index"))
    )


WEATHER_COLUMNS = {"station_code", "observation_time", "weather_severity_index"}


def with_weather(
    flights: DataFrame,
    weather: DataFrame | None,
    departure: str = DEPARTURE,
    limit: int | None = None,
    small: int | None = None,
) -> DataFrame:
    """Severity at the departure station in the hour of departure; 0 when there is none."""
    usable = weather is not None and WEATHER_COLUMNS <= set(weather.columns) and {ORIGIN, departure} <= set(flights.columns)
    plain = flights.drop("weather_severity_index")
    if not usable:
        return plain.withColumn("weather_severity_index", F.lit(0.0))
    timed = plain.withColumn("weather_hour", hour_floor(F.col(departure).cast("timestamp_ntz")))
    keys = [ORIGIN, "weather_hour"]
    joined = lookup_join(timed, stage(hourly_weather(weather)), keys, by=[*keys, departure], limit=limit, small=small)
    return joined.withColumn(
        "weather_severity_index", F.coalesce("weather_severity_index", F.lit(0.0))
    ).drop("weather_hour")
