"""The flight tables as views of the order tables, for Spark.

An order is a flight, its customer the recurring flight number, the customer's nation the
destination; a line item is a bag and a booking; a part is a remark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyload.config import Settings
from skyload.operators.spread import in_parts
from skyload.sources.tables import Inputs

KEY = ["flight_id"]
SETTINGS = Settings(
    key=KEY, home_country="AMERICA", mobility_keywords=("HOT", "RED"), special_keywords=("PROMO",)
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def minutes(value):
    return F.make_dt_interval(mins=value.cast("int"))


def flights(spark: SparkSession, folder: str, delays: bool = False) -> DataFrame:
    orders, customer, nation = (table(spark, folder, name) for name in ("orders", "customer", "nation"))
    number, person = F.col("o_orderkey"), F.col("o_custkey")
    departure = F.col("o_orderdate") + F.make_dt_interval(hours=(number % 24).cast("int")) + minutes(number % 60)
    fleet = F.element_at(F.array(*map(F.lit, ["738", "767-300", "A330", "E175", "777"])), (number % 5 + 1).cast("int"))
    joined = orders.join(customer, person == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    columns = [
        number.alias("flight_id"),
        person.alias("flight_number"),
        F.col("o_orderdate").cast("date").alias("scheduled_departure_date_local"),
        F.concat(F.lit("S"), person % 40).alias("scheduled_departure_station_code"),
        F.col("n_name").alias("scheduled_arrival_station_code"),
        departure.alias("scheduled_departure_datetime_local"),
        (departure + minutes(60 + number % 420)).alias("scheduled_arrival_datetime_local"),
        F.when(person % 97 == 0, 0).otherwise(50 + person % 250).cast("int").alias("total_seats"),
        fleet.alias("fleet_type"),
        F.when(F.col("o_orderstatus") == "P", "Express").otherwise("Mainline").alias("carrier"),
        (20 + number % 90).cast("int").alias("scheduled_ground_time_minutes"),
        (15 + number * 13 % 100).cast("int").alias("actual_ground_time_minutes"),
        (30 + person % 40).cast("int").alias("minimum_turn_minutes"),
    ]
    if not delays:
        return joined.select(*columns)
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    late = number * 37 % 61 - 20 + 2 * F.coalesce("lines", F.lit(0))
    return joined.join(lines, "o_orderkey", "left").select(
        *columns, (departure + minutes(late)).alias("actual_departure_datetime_local")
    )


def bags(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("l_returnflag")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("flight_id"),
        F.when(kind == "N", "Origin").when(kind == "A", "Transfer").otherwise("Hot Transfer").alias("bag_type"),
        F.col("l_shipdate").alias("bag_tag_issue_datetime"),
    )


def bookings(spark: SparkSession, folder: str, dates: bool = False) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    columns = [
        F.col("l_orderkey").alias("flight_id"),
        F.col("l_partkey").alias("record_locator"),
        F.col("l_shipdate").alias("pnr_creation_date"),
        F.col("l_quantity").cast("int").alias("total_pax"),
        F.when(F.col("l_linestatus") == "F", "Y").otherwise("N").alias("is_child"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "Y").otherwise("N").alias("is_stroller_user"),
        (F.col("l_linenumber") % 3).alias("lap_child_count"),
        F.when(F.col("l_discount") >= 0.05, F.col("l_quantity")).otherwise(0).cast("int").alias("basic_economy_pax"),
    ]
    if not dates:
        return rows.select(*columns)
    days = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("scheduled_departure_date_local")
    )
    # All that follows on the flight key stays in these parts.
    parted = [in_parts(side, ["l_orderkey"], rows.count()) for side in (rows, days)]
    return parted[0].join(parted[1], "l_orderkey").select(*columns, "scheduled_departure_date_local")


def remarks(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("p_partkey")
    return table(spark, folder, "part").select(
        (number - number % 2).alias("record_locator"),
        F.concat_ws(" ", "p_name", "p_type").alias("special_service_request"),
    )


def airports(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("airport_iata_code"), F.col("r_name").alias("iso_country_code")
    )


def event_flights(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a departure, for the join with the weather."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("flight_id"),
        F.concat(F.lit("S"), F.col("user_id") % 10).alias("scheduled_departure_station_code"),
        F.col("ts").alias("scheduled_departure_datetime_local"),
    )


def weather(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a weather report."""
    return table(spark, folder, "events").select(
        F.concat(F.lit("S"), F.col("user_id") % 10).alias("station_code"),
        F.col("ts").alias("observation_time"),
        F.col("value").alias("weather_severity_index"),
    )


def flight_weather(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a weather report at the stations and in the years of the flights."""
    number = F.col("event_id")
    first = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, folder, "events").select(
        F.concat(F.lit("S"), F.col("user_id") % 40).alias("station_code"),
        (first + F.make_dt_interval(hours=(number * 37 % 60000).cast("int"), mins=(number % 60).cast("int"))).alias("observation_time"),
        F.col("value").alias("weather_severity_index"),
    )


def inputs(spark: SparkSession, folder: str, delays: bool = False) -> Inputs:
    return Inputs(
        flights=flights(spark, folder, delays),
        bags=bags(spark, folder),
        bookings=bookings(spark, folder, dates=True),
        remarks=remarks(spark, folder),
        airports=airports(spark, folder),
        weather=flight_weather(spark, folder),
    )
