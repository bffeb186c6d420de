"""Bag features per flight: counts by type, transfer share, issue timing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyload.config import DEPARTURE, FLIGHT_KEY
from skyload.functions.columns import first_present, flag, ratio, wall_micros
from skyload.operators.spread import WIDE_BUCKETS, prior_totals, spread_join
from skyload.operators.staging import stage

# Bag types, and the columns that may hold the time of issue, best first.
CHECKED, TRANSFER, HOT_TRANSFER, ORIGIN_BAG = "Checked", "Transfer", "Hot Transfer", "Origin"
ISSUE_COLUMNS = ("bag_tag_issue_datetime", "bag_issue_datetime", "bag_tag_issue_date")


def with_checked_type(bags: DataFrame) -> DataFrame:
    """Bags that start their trip on this flight count as checked; without types all are unknown."""
    if "bag_type" not in bags.columns:
        return bags.withColumn("bag_type", F.lit("Unknown"))
    kind = F.col("bag_type")
    return bags.withColumn("bag_type", F.when(kind == ORIGIN_BAG, CHECKED).otherwise(kind))


def type_counts() -> list[Column]:
    kind = F.col("bag_type")
    return [
        F.count_if(kind == CHECKED).alias("checked"),
        F.count_if(kind == TRANSFER).alias("transfer"),
        F.count_if(kind == HOT_TRANSFER).alias("hot"),
    ]


def derived_counts(checked: Column, transfer: Column, hot: Column) -> list[Column]:
    """Totals that include hot transfers; the share is null without counted bags."""
    moved, everything = transfer + hot, checked + transfer + hot
    return [
        checked.alias("checked_bags"),
        hot.alias("hot_transfer_count"),
        moved.alias("total_transfer_bags"),
        everything.alias("total_bags"),
        ratio(moved, everything).alias("transfer_ratio"),
    ]


def bag_counts(bags: DataFrame, key: Sequence[str] = FLIGHT_KEY) -> DataFrame:
    """One row per flight with the counts that enter the score."""
    counted = with_checked_type(bags.dropna(subset=list(key))).groupBy(*key).agg(*type_counts())
    return counted.select(*key, *derived_counts(F.col("checked"), F.col("transfer"), F.col("hot")))


def bag_shares(bags: DataFrame, key: Sequence[str] = FLIGHT_KEY) -> DataFrame:
    """Transfer share over checked and plain transfer bags only, as the exploratory metrics use it."""
    counted = with_checked_type(bags.dropna(subset=list(key))).groupBy(*key).agg(*type_counts())
    everything = F.col("checked") + F.col("transfer")
    return counted.select(
        *key,
        F.col("checked").alias("checked_bags"),
        F.col("transfer").alias("transfer_bags"),
        everything.alias("total_bags"),
        ratio(F.col("transfer"), everything).alias("transfer_ratio"),
    )


def departure_times(flights: DataFrame, key: Sequence[str], departure: str) -> tuple[DataFrame, DataFrame]:
    """Distinct departure times per flight, and one row per flight with its first, their number and mean.

    ``_times`` counts a missing time too, ``_known`` does not; ``_mean`` is in microseconds.
    """
    times = flights.dropna(subset=list(key)).select(*key, F.col(departure).cast("timestamp_ntz").alias("_time")).distinct()
    at = wall_micros(F.col("_time"))
    facts = times.groupBy(*key).agg(
        F.min("_time").alias("_first"), F.count(F.lit(1)).alias("_times"), F.count("_time").alias("_known"), F.avg(at).alias("_mean")
    )
    return times.where(F.col("_time").isNotNull()).select(*key, at.alias("_at")), facts


def issue_cells(bags: DataFrame, key: Sequence[str], issued: str) -> DataFrame:
    """Bags by type per flight and time of issue."""
    return (
        with_checked_type(bags)
        .groupBy(*key, wall_micros(F.col(issued)).alias("_at"))
        .agg(*type_counts(), F.count(F.lit(1)).alias("_bags"))
    )


def late_counts(bags: DataFrame, issued: str, times: DataFrame, facts: DataFrame, key: Sequence[str]) -> DataFrame:
    """(…key, _swept): for flights with several departure times, the bags issued at or after each of them, added up.

    Times and moments of issue form one ordered stream per flight. Running totals over it, in three levels of buckets, tell how many
    times lie at or before each moment, so neither a flight with very many times nor one with very many bags is listed or
    sorted in one task. The flights are found first and written, so that only their bags are counted again, and once for all levels.
    """
    several = stage(facts.where(F.col("_known") > 1).select(*key))
    cells = issue_cells(bags.join(several, list(key), "left_semi"), key, issued)
    moments = cells.where(F.col("_at").isNotNull()).select(*key, "_at", F.lit(0).alias("_time"), F.col("_bags"))
    marks = times.join(several, list(key), "left_semi")
    stream = marks.select(*key, "_at", F.lit(1).alias("_time"), F.lit(0).cast("bigint").alias("_bags")).unionByName(moments)
    swept = prior_totals(stream, key, "_at", {"_past": F.sum("_time"), "_issued": F.sum("_bags")}, widths=WIDE_BUCKETS)
    return swept.groupBy(*key).agg(F.sum(F.col("_issued") * (F.col("_past_before") + F.col("_past"))).alias("_swept"))


def bag_features(
    bags: DataFrame,
    flights: DataFrame,
    key: Sequence[str] = FLIGHT_KEY,
    departure: str = DEPARTURE,
    limit: int | None = None,
) -> DataFrame:
    """Counts and issue timing per flight from one pass over the bags.

    Bags are counted per flight and issue time before the departure time is joined, so the join sees
    combined rows, and flights with very many bags are split over several tasks. A flight listed with
    several departure times compares each bag with all of them: the mean lead follows from the mean time, late bags from
    :func:`late_counts`.
    """
    issued = first_present(bags.columns, ISSUE_COLUMNS)
    if issued is None or departure not in flights.columns:
        nothing = {"bag_issue_lead_mean": F.lit(0.0), "bag_late_issue_ratio": F.lit(0.0)}
        return bag_counts(bags, key).withColumns(nothing)

    keyed = bags.dropna(subset=list(key))
    cells = issue_cells(keyed, key, issued)
    times, facts = departure_times(flights, key, departure)
    timed = spread_join(cells, facts, key, sizes=keyed, by=[*key, "_at"], limit=limit)
    first = wall_micros(F.col("_first"))
    late = F.when(F.col("_known") <= 1, flag(first <= F.col("_at")))
    timed = timed.withColumns({"_lead": (F.col("_mean") - F.col("_at")) / 86400e6, "_late": late})
    lead, rows = F.col("_lead"), F.col("_bags")
    sums = (
        timed.groupBy(*key)
        .agg(
            *[F.sum(name).alias(name) for name in ("checked", "transfer", "hot")],
            (F.sum(lead * rows) / F.sum(F.when(lead.isNotNull(), rows))).alias("bag_issue_lead_mean"),
            F.sum(F.col("_late") * rows).alias("_counted"),
            F.sum(rows * F.coalesce("_times", F.lit(1))).alias("_pairs"),
        )
        .join(late_counts(keyed, issued, times, facts, key), list(key), "left")
        .withColumn("bag_late_issue_ratio", F.coalesce("_swept", "_counted", F.lit(0)) / F.col("_pairs"))
    )
    return sums.select(
        *key,
        *derived_counts(F.col("checked"), F.col("transfer"), F.col("hot")),
        F.coalesce("bag_issue_lead_mean", F.lit(0.0)).alias("bag_issue_lead_mean"),
        F.coalesce("bag_late_issue_ratio", F.lit(0.0)).alias("bag_late_issue_ratio"),
    )
