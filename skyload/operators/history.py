"""Features from earlier days: volatility of a flight number, past difficulty of a destination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from skyload.config import DAY, DESTINATION
from skyload.functions.columns import day_number
from skyload.operators.spread import lookup_join, trailing_window
from skyload.operators.staging import stage

DIFFICULT = "Difficult"


def with_volatility(
    master: DataFrame,
    features: Sequence[str] = ("load_factor", "ground_time_pressure"),
    window: int = 5,
    group: str = "flight_number",
    day: str = DAY,
    ties: Sequence[str] = (),
    sizes: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Sample deviation over the previous occurrences of the flight number; 0 with fewer than two values."""
    if not {group, day} <= set(master.columns):
        return master.withColumns({f"{name}_volatility": F.lit(0.0) for name in features})

    def deviation(name: str):
        def over(frame: WindowSpec) -> Column:
            enough = F.count(name).over(frame) >= 2
            return F.when(enough, F.stddev_samp(name).over(frame))

        return over

    outputs = {f"{name}_volatility": deviation(name) for name in features}
    framed = trailing_window(master, group, day, ties, window, outputs, sizes, limit)
    return framed.fillna(0.0, subset=list(outputs))


def daily_destinations(scored: DataFrame, day: str = DAY, destination: str = DESTINATION) -> DataFrame:
    """Classified and difficult flights per destination and day."""
    return (
        scored.dropna(subset=[destination, day])
        .groupBy(destination, day)
        .agg(
            F.count("difficulty_class").alias("flights"),
            F.count_if(F.col("difficulty_class") == DIFFICULT).alias("difficult"),
        )
    )


def destination_baseline(
    daily: DataFrame,
    window: int = 7,
    min_flights: int = 5,
    calendar: bool = False,
    day: str = DAY,
    destination: str = DESTINATION,
) -> DataFrame:
    """Share of difficult flights over earlier days; null below ``min_flights``.

    The frame is the previous observed days, or calendar days. The input has one row per
    destination and day, so a window partition is as long as the calendar at most.
    """
    by_day = Window.partitionBy(destination).orderBy(day_number(F.col(day)))
    frame = by_day.rangeBetween(-window, -1) if calendar else by_day.rowsBetween(-window, -1)
    flights, difficult = F.sum("flights").over(frame), F.sum("difficult").over(frame)
    rate = F.when(flights >= min_flights, difficult / F.nullif(flights, F.lit(0)))
    return daily.withColumn("destination_base_difficulty", rate)


def with_baseline_values(
    flights: DataFrame,
    base: DataFrame,
    day: str = DAY,
    destination: str = DESTINATION,
    limit: int | None = None,
    small: int | None = None,
) -> DataFrame:
    """Attach the baseline of its destination and day to each flight; 0 where there is none."""
    keys = [destination, day]
    values = base.select(*keys, "flights", "destination_base_difficulty")
    joined = lookup_join(flights, values, keys, rows="flights", limit=limit, small=small)
    return joined.fillna(0.0, subset=["destination_base_difficulty"])


def with_destination_baseline(
    scored: DataFrame,
    window: int = 7,
    min_flights: int = 5,
    calendar: bool = False,
    day: str = DAY,
    destination: str = DESTINATION,
    limit: int | None = None,
    small: int | None = None,
) -> DataFrame:
    """The baseline from the classes of a scored table, attached to its flights."""
    daily = daily_destinations(scored, day, destination)
    base = stage(destination_baseline(daily, window, min_flights, calendar, day, destination))
    return with_baseline_values(scored.drop("destination_base_difficulty"), base, day, destination, limit, small)
