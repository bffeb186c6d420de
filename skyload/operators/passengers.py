"""Booking features per flight: passengers, children, booking lead, load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyload.config import DAY, FLIGHT_KEY
from skyload.functions.columns import flag, or_zero, ratio, whole_days_between


def with_booking_lead(
    bookings: DataFrame, late_days: int = 3, created: str = "pnr_creation_date", day: str = DAY
) -> DataFrame:
    """Whole days from creation to the start of the departure day, and whether that is late."""
    if created in bookings.columns and day in bookings.columns:
        lead = whole_days_between(F.col(created), F.col(day))
    else:
        lead = F.lit(None).cast("bigint")
    return bookings.withColumn("booking_lead_days", lead).withColumn(
        "late_booking_flag", flag(F.col("booking_lead_days") <= late_days)
    )


def total(name: str) -> Column:
    """Sum that is 0, not null, when every value is missing."""
    return or_zero(F.sum(name))


def passenger_features(
    bookings: DataFrame, key: Sequence[str] = FLIGHT_KEY, late_days: int = 3, day: str = DAY
) -> DataFrame:
    """One row per flight.

    Bookings are first summed per flight and lead day, where Spark combines before it shuffles. The exact
    median is read off the running count of a flight's bookings by lead day; its window sees as
    many rows as a flight has lead days.
    """
    economy = "basic_economy_pax" if "basic_economy_pax" in bookings.columns else "total_pax"
    cells = (
        with_booking_lead(bookings.dropna(subset=list(key)), late_days, day=day)
        .groupBy(*key, "booking_lead_days")
        .agg(
            total("total_pax").alias("pax"),
            total(economy).alias("economy"),
            F.count_if(F.col("is_child") == "Y").alias("children"),
            F.count_if(F.col("is_stroller_user") == "Y").alias("strollers"),
            total("lap_child_count").alias("laps"),
            F.sum("late_booking_flag").alias("late"),
            F.count(F.lit(1)).alias("bookings"),
        )
    )
    lead, rows = F.col("booking_lead_days"), F.col("bookings")
    known = F.when(lead.isNotNull(), rows)
    flight = Window.partitionBy(*key)
    counted = cells.withColumns(
        {
            "_known": F.sum(known).over(flight),
            "_passed": F.sum(known).over(flight.orderBy(lead).rowsBetween(Window.unboundedPreceding, 0)),
        }
    )

    def lead_at(place: Column) -> Column:
        return F.min(F.when(lead.isNotNull() & (F.col("_passed") >= place), lead))

    below, above = lead_at(F.ceil(F.col("_known") / 2)), lead_at(F.floor(F.col("_known") / 2) + 1)
    return counted.groupBy(*key).agg(
        F.sum("pax").cast("bigint").alias("total_pax"),
        F.sum("economy").cast("bigint").alias("basic_economy_pax"),
        F.sum("children").alias("children"),
        F.sum("strollers").alias("stroller_users"),
        F.sum("laps").cast("bigint").alias("lap_children"),
        (F.sum(lead * rows) / F.sum(known)).alias("booking_lead_days_mean"),
        ((below + above) / 2).alias("booking_lead_days_median"),
        (F.sum("late") / F.sum(rows)).alias("late_booking_ratio"),
    )


def passenger_totals(bookings: DataFrame, key: Sequence[str] = FLIGHT_KEY) -> DataFrame:
    """Passengers per flight, for the load metrics."""
    return bookings.dropna(subset=list(key)).groupBy(*key).agg(total("total_pax").cast("bigint").alias("total_pax"))


def with_load(flights: DataFrame) -> DataFrame:
    """Fill missing passenger counts and add the load and basic-economy ratios."""
    pax = or_zero(F.col("total_pax"))
    added = {"total_pax": pax, "load_factor": pax / F.nullif(F.col("total_seats"), F.lit(0))}
    if "basic_economy_pax" in flights.columns:
        added["basic_economy_ratio"] = or_zero(ratio(F.col("basic_economy_pax"), pax))
    else:
        added["basic_economy_ratio"] = F.lit(0.0)
    return flights.withColumns(added)
