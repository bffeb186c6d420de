"""Every registered query: the Spark side, its output columns, and the SQL that must agree."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyload.config import DAY, DEFAULT_WEIGHTS, DEPARTURE, DESTINATION, FULL_WEIGHTS, LIFT_FEATURES, ORIGIN, usable_features
from skyload.functions.parsing import parse_date, parse_timestamp, parse_utc_timestamp
from skyload.operators import bags, charts, context, history, insights, measures, passengers, scoring, service, tuning, turn
from skyload.operators.spread import attach_all, spread_join
from skyload.operators.staging import shared_folder, stage
from skyload.plans import features as feature_plans
from skyload.plans import reports
from skyload.sources import sinks
from skyload.sources import tables as readers
from workbench import tables
from workbench.ctes import CALENDAR_FRAME, DEFAULTS, DEST, FIRST, SLICE, corr, number, scaled_sql, with_ctes
from workbench.ctes import DEFAULT_WEIGHTS as SQL_WEIGHTS
from workbench.tables import KEY, SETTINGS


@dataclass(frozen=True)
class Case:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CASES: dict[str, Case] = {}


def spark_columns(df: DataFrame, columns: dict) -> DataFrame:
    """Integers as bigint, digits as rounded double, the rest as text."""
    picked = []
    for name, kind in columns.items():
        value = F.col(name)
        if kind == "i":
            value = value.cast("bigint")
        elif kind == "s":
            value = value.cast("string")
        else:
            value = F.round(value.cast("double"), kind) + F.lit(0.0)
        picked.append(value.alias(name))
    return df.select(*picked)


def sql_columns(columns: dict) -> str:
    kinds = {"i": "CAST({0} AS BIGINT)", "s": "CAST({0} AS VARCHAR)"}
    return ", ".join(
        f"{kinds.get(kind, 'round(CAST({0} AS DOUBLE), ' + str(kind) + ') + 0.0').format(name)} AS {name}"
        for name, kind in columns.items()
    )


def case(name: str, columns: dict, source: str | None, needs: tuple = ()):
    """Register a query; ``source`` is the SQL after FROM, over the named queries ``needs``."""

    def register(run):
        sql = None if source is None else with_ctes(needs, f"SELECT {sql_columns(columns)} FROM {source}")
        CASES[name] = Case(lambda spark, folder: spark_columns(run(spark, folder), columns), sql)
        return run

    return register


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Shared Spark steps -----------------------------------------------------------------------------


def scoring_columns(master: DataFrame, features: list[str]) -> DataFrame:
    """What scoring and the queries after it read; nothing else is worth writing."""
    wanted = {"flight_id", "flight_number", DAY, DESTINATION, DEPARTURE, "actual_departure_datetime_local", *features}
    return master.select(*[name for name in master.columns if name in wanted])


def full_master(spark: SparkSession, folder: str) -> DataFrame:
    return feature_plans.build_features(tables.inputs(spark, folder), SETTINGS)


def default_master(spark: SparkSession, folder: str, delays: bool = False) -> DataFrame:
    """The features of the default weights, and no others."""
    source = tables.inputs(spark, folder, delays)
    aggregates = [
        passengers.passenger_features(source.bookings, KEY),
        bags.bag_counts(source.bags, KEY),
        service.service_features(source.bookings, source.remarks, KEY, SETTINGS.mobility_keywords, SETTINGS.special_keywords),
    ]
    joined = attach_all(source.flights, aggregates, KEY, sizes=source.flights, by=[*KEY, DEPARTURE])
    joined = joined.fillna(0, subset=[*feature_plans.COUNTS, "transfer_ratio"])
    joined = context.with_aircraft(turn.with_turn_features(passengers.with_load(joined)))
    return context.with_country(joined, source.airports, SETTINGS.home_country)


def default_scored(spark: SparkSession, folder: str, delays: bool = False) -> DataFrame:
    return scoring.score_days(stage(scoring_columns(default_master(spark, folder, delays), DEFAULTS)), DEFAULT_WEIGHTS)


def staged_slice(spark: SparkSession, folder: str) -> DataFrame:
    return stage(scoring_columns(default_master(spark, folder), DEFAULTS))


def slice_scored(spark: SparkSession, folder: str) -> DataFrame:
    return default_scored(spark, folder)


def requested_loads(spark: SparkSession, folder: str) -> DataFrame:
    """Flights with delay, load and request count."""
    booked = tables.bookings(spark, folder)
    flights = tables.flights(spark, folder, delays=True)
    loads = measures.flight_loads(flights, booked, KEY)
    requests = service.service_features(booked, tables.remarks(spark, folder), KEY)
    return measures.with_request_counts(loads, requests, KEY, sizes=tables.flights(spark, folder))


# Sources and sinks ------------------------------------------------------------------------------


@case(
    "csv_scan_clean",
    {"o_orderkey": "i", "o_orderstatus": "s", "o_orderpriority": "s", "o_totalprice": 2, "remark": "s"},
    """(SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
        CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS o_orderpriority,
        CASE WHEN o_orderkey % 10 > 1 THEN o_totalprice END AS o_totalprice,
        'needs "' || o_orderpriority || '", at' || chr(10) || 'gate ' || CAST(o_orderkey AS VARCHAR) AS remark FROM orders)""",
)
def csv_scan_clean(spark, folder):
    path = scratch(spark, "orders-csv")
    missing = F.element_at(F.array(*map(F.lit, ["NA", "null", "n/a", "NaN"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    tables.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias(" o_orderkey"),
        F.when(F.col("o_orderstatus") == "P", missing).otherwise(F.col("o_orderstatus")).alias("o_orderstatus "),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(F.col("o_orderkey") % 10 == 0, " NaN").when(F.col("o_orderkey") % 10 == 1, "Infinity")
        .otherwise(F.col("o_totalprice").cast("string")).alias(" o_totalprice "),
        F.concat(F.lit('needs "'), "o_orderpriority", F.lit('", at\ngate '), "o_orderkey").alias("remark"),
    ).write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, escape='"').csv(path)
    return readers.read_csv(spark, path, {"o_orderkey": "bigint", "o_totalprice": "double"})


@case(
    "parse_dates",
    {"o_orderkey": "i", "parsed": "s"},
    "(SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders)",
)
def parse_dates(spark, folder):
    day, style = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = (
        F.when(style == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(style == 1, F.date_format(day, "M/d/yyyy"))
        .when(style == 2, F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.concat(F.lit("day "), F.date_format(day, "D")))
    )
    return tables.table(spark, folder, "orders").select("o_orderkey", parse_date(text).alias("parsed"))


@case(
    "parse_timestamps",
    {"o_orderkey": "i", "wall": "s", "utc": "s"},
    """(SELECT o_orderkey, strftime(wall, '%Y-%m-%d %H:%M:%S') AS wall, strftime(utc, '%Y-%m-%d %H:%M:%S') AS utc FROM (SELECT o_orderkey,
        CASE WHEN o_orderkey % 5 < 4 THEN t END AS wall, CASE WHEN o_orderkey % 5 = 1 THEN t - to_hours(2) WHEN o_orderkey % 5 < 4 THEN t END AS utc
        FROM (SELECT o_orderkey, o_orderdate + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) AS t FROM orders)))""",
)
def parse_timestamps(spark, folder):
    """Five styles: ISO, ISO with an offset, month first, the same with seconds and blanks, and no time at all."""
    number = F.col("o_orderkey")
    time = F.col("o_orderdate") + tables.minutes(number % 24 * 60 + number % 60)
    text = (
        F.when(number % 5 == 0, F.date_format(time, "yyyy-MM-dd HH:mm:ss"))
        .when(number % 5 == 1, F.concat(F.date_format(time, "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00")))
        .when(number % 5 == 2, F.date_format(time, "M/d/yyyy H:mm"))
        .when(number % 5 == 3, F.concat(F.lit(" "), F.date_format(time, "M/d/yyyy HH:mm:ss"), F.lit(" ")))
        .otherwise("13/45/1999 8:15")
    )
    shown = "yyyy-MM-dd HH:mm:ss"
    return tables.table(spark, folder, "orders").select(
        "o_orderkey", F.date_format(parse_timestamp(text), shown).alias("wall"), F.date_format(parse_utc_timestamp(text), shown).alias("utc")
    )


@case(
    "weather_absent_zero",
    {"flight_id": "i", "weather_severity_index": 6},
    "(SELECT flight_id, 0 AS weather_severity_index FROM event_flights)",
    ("event_flights",),
)
def weather_absent_zero(spark, folder):
    none = readers.read_weather(spark, f"{folder}/weather_is_not_here.csv")
    return context.with_weather(tables.event_flights(spark, folder), none)


@case(
    "sink_roundtrip",
    {"flight_id": "i", DAY: "s", "difficulty_score": 9, "daily_rank": "i", "difficulty_class": "s"},
    "slice_scored",
    ("slice_scored",),
)
def sink_roundtrip(spark, folder):
    path = scratch(spark, "scores")
    sinks.write_scores(slice_scored(spark, folder), path, per="month")
    return sinks.read_scores(spark, path)


SOME_DAYS = ("1994-03-01", "1995-03-02", "1995-03-31", "1996-12-24")


@case(
    "scores_of_some_days",
    {"flight_id": "i", DAY: "s", "difficulty_score": 9, "daily_rank": "i", "difficulty_class": "s"},
    f"(SELECT * FROM slice_scored WHERE CAST({DAY} AS VARCHAR) IN {SOME_DAYS})",
    ("slice_scored",),
)
def scores_of_some_days(spark, folder):
    """Some days of stored scores; only the folders of their months are read."""
    path = scratch(spark, "scores")
    sinks.write_scores(slice_scored(spark, folder), path, per="month")
    return sinks.read_scores(spark, path, days=SOME_DAYS)


@case(
    "scores_csv_roundtrip",
    {"flight_id": "i", DAY: "s", "difficulty_score": 9, "daily_rank": "i", "difficulty_class": "s", "load_factor_scaled": 9},
    "slice_scored",
    ("slice_scored",),
)
def scores_csv_roundtrip(spark, folder):
    path = scratch(spark, "scores-csv")
    sinks.write_scores(slice_scored(spark, folder), path, per="month", format="csv")
    return sinks.read_scores(spark, path, source="csv")


@case(
    "input_row_counts",
    {"table_name": "s", "rows": "i", "rows_without_key": "i"},
    """(SELECT *, 0 AS rows_without_key FROM (SELECT 'flights' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'bags', count(*) FROM lineitem
        UNION ALL SELECT 'bookings', count(*) FROM lineitem UNION ALL SELECT 'remarks', count(*) FROM part
        UNION ALL SELECT 'airports', count(*) FROM nation UNION ALL SELECT 'weather', count(*) FROM events))""",
)
def input_row_counts(spark, folder):
    return readers.input_counts(tables.inputs(spark, folder), KEY)


# Features ---------------------------------------------------------------------------------------


@case(
    "booking_lead",
    {"flight_id": "i", "booking_lead_days_mean": 9, "booking_lead_days_median": 9, "late_booking_ratio": 9},
    "passengers",
    ("passengers",),
)
@case(
    "passenger_agg",
    {"flight_id": "i", "total_pax": "i", "basic_economy_pax": "i", "children": "i", "stroller_users": "i",
     "lap_children": "i", "booking_lead_days_mean": 9, "booking_lead_days_median": 9, "late_booking_ratio": 9},
    "passengers",
    ("passengers",),
)
def passenger_agg(spark, folder):
    return passengers.passenger_features(tables.bookings(spark, folder, dates=True), KEY)


@case(
    "bag_features",
    {"flight_id": "i", "checked_bags": "i", "hot_transfer_count": "i", "total_transfer_bags": "i", "total_bags": "i",
     "transfer_ratio": 9, "bag_per_seat_ratio": 9},
    """(SELECT f.flight_id, coalesce(checked_bags, 0) AS checked_bags, coalesce(hot_transfer_count, 0) AS hot_transfer_count,
        coalesce(total_transfer_bags, 0) AS total_transfer_bags, coalesce(total_bags, 0) AS total_bags,
        coalesce(transfer_ratio, 0) AS transfer_ratio,
        coalesce(total_bags / nullif(CAST(total_seats AS DOUBLE), 0), 0) AS bag_per_seat_ratio
        FROM flights f LEFT JOIN bag_counts USING (flight_id))""",
    ("flights", "bag_counts"),
)
def bag_features(spark, folder):
    flights = tables.flights(spark, folder)
    counts = bags.bag_counts(tables.bags(spark, folder), KEY)
    joined = spread_join(flights, counts, KEY, sizes=flights, by=[*KEY, DEPARTURE])
    filled = joined.fillna(0, subset=["checked_bags", "hot_transfer_count", "total_transfer_bags", "total_bags", "transfer_ratio"])
    return context.with_bags_per_seat(filled)


@case(
    "bag_ratio_eda",
    {"flight_id": "i", "checked_bags": "i", "transfer_bags": "i", "total_bags": "i", "transfer_ratio": 9},
    "bag_shares",
    ("bag_shares",),
)
def bag_ratio_eda(spark, folder):
    return bags.bag_shares(tables.bags(spark, folder), KEY)


@case(
    "bag_timing",
    {"flight_id": "i", "total_bags": "i", "bag_issue_lead_mean": 9, "bag_late_issue_ratio": 9},
    "bag_timing JOIN bag_counts USING (flight_id)",
    ("bag_timing", "bag_counts"),
)
def bag_timing(spark, folder):
    return bags.bag_features(tables.bags(spark, folder), tables.flights(spark, folder), KEY)


@case(
    "bag_timing_repeated",
    {"flight_number": "i", "total_bags": "i", "bag_issue_lead_mean": 9, "bag_late_issue_ratio": 9},
    """(SELECT flight_number, max(n) AS total_bags, avg(lead) AS bag_issue_lead_mean, avg(CASE WHEN lead <= 0 THEN 1.0 ELSE 0.0 END) AS bag_late_issue_ratio
        FROM (SELECT b.flight_number, n, (epoch_us(scheduled_departure_datetime_local) - epoch_us(bag_tag_issue_datetime)) / 86400000000.0 AS lead
        FROM (SELECT flight_number, bag_tag_issue_datetime, count(*) OVER (PARTITION BY flight_number) AS n FROM bags JOIN flights USING (flight_id)) b
        JOIN (SELECT DISTINCT flight_number, scheduled_departure_datetime_local FROM flights) f USING (flight_number)) GROUP BY 1)""",
    ("bags", "flights"),
)
def bag_timing_repeated(spark, folder):
    """Timing by flight number alone: every bag of a number against all departures that the number has."""
    flights = tables.flights(spark, folder).select("flight_id", "flight_number", DEPARTURE)
    numbered = tables.bags(spark, folder).join(flights.select("flight_id", "flight_number"), "flight_id")
    return bags.bag_features(numbered, flights, ["flight_number"])


@case(
    "turn_features",
    {"flight_id": "i", "ground_time_pressure": "i", "actual_turn_deficit": "i", "turn_deficit_ratio": 9},
    "slice",
    ("slice",),
)
def turn_features(spark, folder):
    return turn.with_turn_features(tables.flights(spark, folder))


@case(
    "international_flag",
    {"flight_id": "i", DESTINATION: "s", "iso_country_code": "s", "is_international": "i"},
    f"""(SELECT flight_id, {DEST}, iso_country_code, CASE WHEN iso_country_code = 'AMERICA' THEN 0 ELSE 1 END AS is_international
        FROM flights LEFT JOIN airports ON {DEST} = airport_iata_code)""",
    ("flights", "airports"),
)
def international_flag(spark, folder):
    return context.with_country(tables.flights(spark, folder), tables.airports(spark, folder), SETTINGS.home_country)


@case(
    "load_factor",
    {"flight_id": "i", "total_pax": "i", "load_factor": 9, "basic_economy_ratio": 9},
    """(SELECT f.flight_id, coalesce(p.total_pax, 0) AS total_pax, coalesce(p.total_pax, 0) / nullif(CAST(total_seats AS DOUBLE), 0) AS load_factor,
        coalesce(basic_economy_pax / nullif(CAST(p.total_pax AS DOUBLE), 0), 0) AS basic_economy_ratio
        FROM flights f LEFT JOIN passengers p USING (flight_id))""",
    ("flights", "passengers"),
)
def load_factor(spark, folder):
    flights = tables.flights(spark, folder)
    booked = passengers.passenger_features(tables.bookings(spark, folder), KEY)
    return passengers.with_load(spread_join(flights, booked, KEY, sizes=flights, by=[*KEY, DEPARTURE]))


@case("aircraft_flags", {"flight_id": "i", "total_seats": "i", "fleet_type": "s", "widebody_flag": "i"}, "slice", ("slice",))
def aircraft_flags(spark, folder):
    return context.with_aircraft(tables.flights(spark, folder))


@case(
    "aircraft_size_bins",
    {"flight_id": "i", "total_seats": "i", "aircraft_size_category": "s"},
    """(SELECT flight_id, total_seats, CASE WHEN total_seats < 0 THEN NULL WHEN total_seats <= 70 THEN 'Regional' WHEN total_seats <= 150 THEN 'Narrowbody'
        WHEN total_seats <= 250 THEN 'Large Narrowbody' ELSE 'Widebody' END AS aircraft_size_category FROM flights)""",
    ("flights",),
)
def aircraft_size_bins(spark, folder):
    return turn.with_extra_features(tables.flights(spark, folder))


@case(
    "extra_features",
    {"flight_id": "i", "turn_buffer_ratio": 9, "scheduled_block_minutes": 9, "long_haul_indicator": "i", "is_express": "i",
     "bag_intensity": 9, "ssr_per_pax": 9, "pressure_index": 9},
    """(SELECT *, scheduled_ground_time_minutes / CAST(minimum_turn_minutes AS DOUBLE) AS turn_buffer_ratio,
        (epoch_us(scheduled_arrival_datetime_local) - epoch_us(scheduled_departure_datetime_local)) / 60000000.0 AS scheduled_block_minutes,
        CASE WHEN epoch_us(scheduled_arrival_datetime_local) - epoch_us(scheduled_departure_datetime_local) >= 21600000000 THEN 1 ELSE 0 END AS long_haul_indicator,
        CASE WHEN lower(carrier) = 'express' THEN 1 ELSE 0 END AS is_express, total_bags / nullif(CAST(total_pax AS DOUBLE), 0) AS bag_intensity,
        ssr_count / nullif(CAST(total_pax AS DOUBLE), 0) AS ssr_per_pax,
        ground_time_pressure * 0.6 + transfer_ratio * 0.2 + ssr_count * 0.2 AS pressure_index FROM master)""",
    ("master",),
)
def extra_features(spark, folder):
    return turn.with_extra_features(default_master(spark, folder))


@case(
    "interaction_terms",
    {"flight_id": "i", "transfer_ground_interaction": 9, "load_pressure_interaction": 9},
    """(SELECT flight_id, transfer_ratio * ground_time_pressure AS transfer_ground_interaction,
        load_factor * ground_time_pressure AS load_pressure_interaction FROM slice)""",
    ("slice",),
)
def interaction_terms(spark, folder):
    return feature_plans.with_interactions(default_master(spark, folder))


@case("distinct_booking_keys", {"flight_id": "i", "record_locator": "i"}, "pairs", ("pairs",))
def distinct_booking_keys(spark, folder):
    return service.booking_keys(tables.bookings(spark, folder), KEY)


def requests(spark, folder, mode):
    return service.service_features(
        tables.bookings(spark, folder), tables.remarks(spark, folder), KEY, SETTINGS.mobility_keywords, SETTINGS.special_keywords, mode
    )


@case("ssr_counts", {"flight_id": "i", "ssr_count": "i"}, "requests", ("requests",))
@case(
    "ssr_categories",
    {"flight_id": "i", "ssr_count": "i", "ssr_mobility_count": "i", "ssr_special_handling_count": "i"},
    "requests",
    ("requests",),
)
def ssr_counts(spark, folder):
    return requests(spark, folder, "locator")


@case("ssr_counts_fanout", {"flight_id": "i", "ssr_count": "i"}, "fanout_requests", ("fanout_requests",))
def ssr_counts_fanout(spark, folder):
    return requests(spark, folder, "fanout")


@case(
    "weather_enrich",
    {"flight_id": "i", ORIGIN: "s", "weather_severity_index": 6},
    f"""(SELECT flight_id, {ORIGIN}, coalesce(weather_severity_index, 0) AS weather_severity_index FROM event_flights LEFT JOIN hourly_weather
        ON {ORIGIN} = station_code AND date_trunc('hour', {DEPARTURE}) = weather_hour)""",
    ("event_flights", "hourly_weather"),
)
def weather_enrich(spark, folder):
    return context.with_weather(tables.event_flights(spark, folder), tables.weather(spark, folder))


@case(
    "slot_congestion",
    {"flight_id": "i", "slot_congestion_count": "i"},
    f"(SELECT *, count(*) OVER (PARTITION BY {ORIGIN}, hour({DEPARTURE})) AS slot_congestion_count FROM flights)",
    ("flights",),
)
def slot_congestion(spark, folder):
    return context.with_slot_congestion(tables.flights(spark, folder))


@case(
    "slot_congestion_per_date",
    {"flight_id": "i", "slot_congestion_count": "i"},
    f"(SELECT *, count(*) OVER (PARTITION BY {ORIGIN}, {DAY}, hour({DEPARTURE})) AS slot_congestion_count FROM flights)",
    ("flights",),
)
def slot_congestion_per_date(spark, folder):
    return context.with_slot_congestion(tables.flights(spark, folder), per_date=True)


@case(
    "trailing_volatility",
    {"flight_id": "i", "load_factor_volatility": 6, "ground_time_pressure_volatility": 6},
    "full_master",
    ("full_master",),
)
def trailing_volatility(spark, folder):
    return history.with_volatility(default_master(spark, folder), ties=KEY, sizes=tables.flights(spark, folder))


@case(
    "trailing_volatility_cut",
    {"flight_id": "i", "load_factor_volatility": 6, "ground_time_pressure_volatility": 6},
    "full_master",
    ("full_master",),
)
def trailing_volatility_cut(spark, folder):
    """The same frames where flight numbers of more than six flights count as large and are cut."""
    return history.with_volatility(default_master(spark, folder), ties=KEY, sizes=tables.flights(spark, folder), limit=6)


@case(
    "optional_columns",
    {"flight_id": "i", "total_pax": "i", "basic_economy_ratio": 9, "booking_lead_days_mean": 9, "late_booking_ratio": 9,
     "total_bags": "i", "ssr_count": "i", "ssr_mobility_count": "i", "ground_time_pressure": "i", "actual_turn_deficit": "i",
     "turn_deficit_ratio": 9, "bag_issue_lead_mean": 9, "slot_congestion_count": "i", "load_factor_volatility": 6,
     "weather_severity_index": 6, "widebody_flag": "i"},
    """(SELECT f.flight_id, coalesce(p.total_pax, 0) AS total_pax, CASE WHEN p.total_pax > 0 THEN 1 ELSE 0 END AS basic_economy_ratio,
        CAST(NULL AS DOUBLE) AS booking_lead_days_mean, CASE WHEN p.flight_id IS NULL THEN NULL ELSE 0 END AS late_booking_ratio,
        0 AS total_bags, coalesce(ssr_count, 0) AS ssr_count, 0 AS ssr_mobility_count, 0 AS ground_time_pressure,
        0 AS actual_turn_deficit, 0 AS turn_deficit_ratio, 0 AS bag_issue_lead_mean, 0 AS slot_congestion_count, 0 AS load_factor_volatility,
        0 AS weather_severity_index, CASE WHEN total_seats >= 250 THEN 1 ELSE 0 END AS widebody_flag
        FROM flights f LEFT JOIN passengers p USING (flight_id) LEFT JOIN requests USING (flight_id))""",
    ("flights", "passengers", "requests"),
)
def optional_columns(spark, folder):
    """All features from tables without any of the optional columns."""
    bare = readers.Inputs(
        flights=tables.flights(spark, folder).select("flight_id", DAY, DESTINATION, "total_seats"),
        bags=tables.bags(spark, folder).select("flight_id"),
        bookings=tables.bookings(spark, folder).drop("pnr_creation_date", "basic_economy_pax"),
        remarks=tables.remarks(spark, folder).select("record_locator"),
        airports=tables.airports(spark, folder),
    )
    return feature_plans.build_features(bare, SETTINGS)


FULL_COLUMNS = {"flight_id": "i", **{name: 6 if name.endswith("volatility") else 9 for name in FIRST}}


@case("flight_features", FULL_COLUMNS, "full_master", ("full_master",))
def flight_features(spark, folder):
    return full_master(spark, folder)


# Scores -----------------------------------------------------------------------------------------


@case("daily_minmax_scale", {"flight_id": "i", DAY: "s", **{f"{name}_scaled": 9 for name in SLICE}}, "slice_scaled", ("slice_scaled",))
def daily_minmax_scale(spark, folder):
    master = staged_slice(spark, folder)
    return scoring.with_day_scaling(master, stage(scoring.day_ranges(master, SLICE)), SLICE)


BROKEN = {"load_factor": "nan", "turn_deficit_ratio": "inf", "total_pax": "-inf"}


@case(
    "broken_numbers",
    {"flight_id": "i", DAY: "s", **{f"{name}_scaled": 9 for name in BROKEN}},
    "("
    + scaled_sql(
        "(SELECT flight_id, scheduled_departure_date_local, "
        + ", ".join(f"CASE WHEN flight_id % {7 + at} <> 0 THEN CAST({name} AS DOUBLE) END AS {name}" for at, name in enumerate(BROKEN))
        + " FROM slice)",
        list(BROKEN),
    )
    + ")",
    ("slice",),
)
def broken_numbers(spark, folder):
    """Scaling of features that hold NaN and infinities; such a value counts as missing."""
    rows = default_master(spark, folder)
    broken = {name: F.when(F.col("flight_id") % (7 + at) == 0, F.lit(float(value))).otherwise(F.col(name).cast("double")) for at, (name, value) in enumerate(BROKEN.items())}
    table = stage(rows.select("flight_id", DAY, *[value.alias(name) for name, value in broken.items()]))
    return scoring.score_days(table, dict.fromkeys(BROKEN, 1.0))


@case("difficulty_score", {"flight_id": "i", DAY: "s", "difficulty_score": 9}, "scored", ("scored",))
def difficulty_score(spark, folder):
    return default_scored(spark, folder)


@case("daily_rank", {"flight_id": "i", DAY: "s", "difficulty_score": 9, "daily_rank": "i"}, "slice_scored", ("slice_scored",))
def daily_rank(spark, folder):
    return slice_scored(spark, folder)


@case("daily_rank_spread", {"flight_id": "i", "daily_rank": "i", "difficulty_class": "s"}, "slice_scored", ("slice_scored",))
def daily_rank_spread(spark, folder):
    """The ranking used when a day is too large for one window."""
    return scoring.score_days(staged_slice(spark, folder), DEFAULT_WEIGHTS, SLICE, strategy="spread")


@case("difficulty_class", {"flight_id": "i", DAY: "s", "daily_rank": "i", "difficulty_class": "s"}, "scored", ("scored",))
def difficulty_class(spark, folder):
    return default_scored(spark, folder)


@case(
    "class_distribution",
    {"difficulty_class": "s", "flights": "i"},
    "(SELECT difficulty_class, count(*) AS flights FROM slice_scored GROUP BY 1)",
    ("slice_scored",),
)
def class_distribution(spark, folder):
    return charts.class_counts(slice_scored(spark, folder))


BASELINE_COLUMNS = {DESTINATION: "s", DAY: "s", "flights": "i", "difficult": "i", "destination_base_difficulty": 9}


@case("destination_baseline", BASELINE_COLUMNS, "slice_baseline", ("slice_baseline",))
def destination_baseline(spark, folder):
    return history.destination_baseline(history.daily_destinations(slice_scored(spark, folder)))


@case("destination_baseline_calendar", BASELINE_COLUMNS, "slice_calendar", ("slice_calendar",))
def destination_baseline_calendar(spark, folder):
    return history.destination_baseline(history.daily_destinations(slice_scored(spark, folder)), calendar=True)


@case(
    "rescore_two_pass",
    {"flight_id": "i", "destination_base_difficulty": 9, "difficulty_score": 9, "daily_rank": "i", "difficulty_class": "s"},
    "second_scored",
    ("second_scored",),
)
def rescore_two_pass(spark, folder):
    master = stage(scoring_columns(full_master(spark, folder), FIRST))
    return scoring.score_twice(master, FULL_WEIGHTS, usable_features(FULL_WEIGHTS, master.columns))


# Insights ---------------------------------------------------------------------------------------


@case(
    "destination_consistency",
    {DESTINATION: "s", "flights": "i", "difficult_flights": "i", "mean_score": 6, "mean_rank": 6, "difficult_rate": 6,
     "difficulty_intensity": 6, "consistency_index": 6},
    f"(SELECT * FROM slice_consistency ORDER BY consistency_index DESC, difficult_rate DESC, mean_score DESC, {DEST} LIMIT 10)",
    ("slice_consistency",),
)
def destination_consistency(spark, folder):
    return insights.destination_consistency(slice_scored(spark, folder), 10)


def lift_rows(source: str) -> str:
    parts = []
    for place, name in enumerate(LIFT_FEATURES):
        hard = f"avg({name}_scaled) FILTER (WHERE difficulty_class = 'Difficult')"
        parts.append(
            f"SELECT {DEST}, '{name}' AS feature, {place} AS place, coalesce({hard}, 0) - coalesce(avg({name}_scaled), 0) AS lift_vs_overall "
            f"FROM {source} GROUP BY 1"
        )
    return " UNION ALL ".join(parts)


TOP_LIFTS = f"""(SELECT {DEST}, feature, lift_vs_overall FROM (SELECT *, row_number() OVER (PARTITION BY {DEST} ORDER BY lift_vs_overall DESC, place) AS n
    FROM ({lift_rows('scored')}) WHERE {DEST} IN (SELECT {DEST} FROM top_destinations)) WHERE n <= 5)"""


def top_drivers(spark, folder):
    scored = stage(default_scored(spark, folder))
    return insights.driver_lifts(scored, insights.destination_consistency(scored, 10))


@case("driver_lifts", {DESTINATION: "s", "feature": "s", "lift_vs_overall": 6}, TOP_LIFTS, ("scored", "top_destinations"))
def driver_lifts(spark, folder):
    return top_drivers(spark, folder)


@case(
    "avg_feature_lift",
    {"feature": "s", "lift_vs_overall": 6},
    f"(SELECT feature, avg(lift_vs_overall) AS lift_vs_overall FROM {TOP_LIFTS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12)",
    ("scored", "top_destinations"),
)
def avg_feature_lift(spark, folder):
    return insights.mean_lifts(top_drivers(spark, folder), 12)


RULES = """('total_bags', 'prepare: baggage'), ('transfer_ratio', 'prepare: baggage'), ('hot_transfer_count', 'prepare: baggage'),
    ('children', 'prepare: families'), ('lap_children', 'prepare: families'), ('stroller_users', 'prepare: families'),
    ('ground_time_pressure', 'prepare: turnaround'), ('ssr_count', 'prepare: assistance'), ('load_factor', 'prepare: seating'),
    ('is_international', 'prepare: border control')"""


@case(
    "recommendations",
    {"recommendation": "s", "lift": 6},
    f"""(SELECT recommendation, max(lift) AS lift FROM (SELECT feature, avg(lift_vs_overall) AS lift FROM {TOP_LIFTS} GROUP BY 1)
        JOIN (VALUES {RULES}) AS rules (feature, recommendation) USING (feature) WHERE lift > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12)""",
    ("scored", "top_destinations"),
)
def recommendations(spark, folder):
    return insights.recommendations(top_drivers(spark, folder))


# Measures and chart tables ----------------------------------------------------------------------


@case("delay_metrics", {"flight_id": "i", "dep_delay_minutes": 9}, "loads", ("loads",))
def delay_metrics(spark, folder):
    return turn.with_delay(tables.flights(spark, folder, delays=True))


@case(
    "ground_time_bands",
    {"flight_id": "i", "ground_time_delta": "i", "at_or_below_min_turn": "i", "within_5_min_above_min": "i"},
    """(SELECT flight_id, ground_time_delta, CASE WHEN ground_time_delta <= 0 THEN 1 ELSE 0 END AS at_or_below_min_turn,
        CASE WHEN ground_time_delta > 0 AND ground_time_delta <= 5 THEN 1 ELSE 0 END AS within_5_min_above_min
        FROM (SELECT flight_id, scheduled_ground_time_minutes - minimum_turn_minutes AS ground_time_delta FROM flights))""",
    ("flights",),
)
def ground_time_bands(spark, folder):
    return turn.with_ground_bands(tables.flights(spark, folder))


@case(
    "eda_summary",
    {"metric": "s", "value": 6},
    f"""(SELECT 'avg_departure_delay_min' AS metric, avg(dep_delay_minutes) AS value FROM loads
        UNION ALL SELECT 'pct_flights_late', count(*) FILTER (WHERE dep_delay_minutes > 0) * 100.0 / count(*) FROM loads
        UNION ALL SELECT 'pct_ground_time_at_or_below_min', count(*) FILTER (WHERE ground_time_delta <= 0) * 100.0 / count(*) FROM loads
        UNION ALL SELECT 'pct_ground_time_within_5_min', count(*) FILTER (WHERE ground_time_delta > 0 AND ground_time_delta <= 5) * 100.0 / count(*) FROM loads
        UNION ALL SELECT 'avg_transfer_ratio', avg(transfer_ratio) FROM bag_shares
        UNION ALL SELECT 'corr_loadfactor_delay', {corr('dep_delay_minutes', 'load_factor')} FROM loads
        UNION ALL SELECT 'corr_loadfactor_ground_delta', {corr('ground_time_delta', 'load_factor')} FROM loads)""",
    ("loads", "bag_shares"),
)
def eda_summary(spark, folder):
    loads = measures.flight_loads(tables.flights(spark, folder, delays=True), tables.bookings(spark, folder), KEY)
    return measures.metric_table(loads, tables.bags(spark, folder), KEY)


@case(
    "corr_load_delay",
    {"metric": "s", "value": 6},
    f"""(SELECT 'dep_delay_minutes~load_factor' AS metric, {corr('dep_delay_minutes', 'load_factor')} AS value FROM loads
        UNION ALL SELECT 'ground_time_delta~load_factor', {corr('ground_time_delta', 'load_factor')} FROM loads)""",
    ("loads",),
)
def corr_load_delay(spark, folder):
    loads = measures.flight_loads(tables.flights(spark, folder, delays=True), tables.bookings(spark, folder), KEY)
    return measures.correlations(loads, [("dep_delay_minutes", "load_factor"), ("ground_time_delta", "load_factor")])


@case(
    "corr_load_score",
    {"metric": "s", "value": 6},
    f"(SELECT 'difficulty_score~load_factor' AS metric, {corr('difficulty_score', 'load_factor')} AS value FROM slice_scored)",
    ("slice_scored",),
)
def corr_load_score(spark, folder):
    return measures.correlations(slice_scored(spark, folder), [("difficulty_score", "load_factor")])


MATRIX = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {corr(a + '_scaled', b + '_scaled')} AS corr FROM scaled" for a in DEFAULTS for b in DEFAULTS
)


@case("feature_corr_matrix", {"feature_a": "s", "feature_b": "s", "corr": 6}, f"({MATRIX})", ("scaled",))
def feature_corr_matrix(spark, folder):
    scored = default_scored(spark, folder)
    return tuning.correlation_matrix(scored, {name: f"{name}_scaled" for name in DEFAULTS})


@case(
    "ssr_high_low",
    {"threshold": 6, "mean_delay_high": 6, "mean_delay_low": 6},
    """(SELECT max(threshold) AS threshold, avg(dep_delay_minutes) FILTER (WHERE ssr_count >= threshold) AS mean_delay_high,
        avg(dep_delay_minutes) FILTER (WHERE ssr_count = 0) AS mean_delay_low
        FROM requested, (SELECT quantile_cont(ssr_count, 0.75) AS threshold FROM requested))""",
    ("requested",),
)
def ssr_high_low(spark, folder):
    return measures.request_groups(requested_loads(spark, folder))


OLS = """(SELECT n AS n_obs, b1 AS coef_ssr_count, b2 AS coef_load_factor, my - b1 * ma - b2 * mb AS intercept,
    (b1 * say + b2 * sby) / syy AS r2
    FROM (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS b1, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS b2
    FROM (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, covar_pop(a, a) AS saa, covar_pop(b, b) AS sbb,
    covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby, covar_pop(y, y) AS syy
    FROM (SELECT CAST(ssr_count AS DOUBLE) AS a, load_factor AS b, dep_delay_minutes AS y FROM requested
    WHERE load_factor IS NOT NULL AND abs(dep_delay_minutes) < 1440))))"""


@case(
    "ols_delay",
    {"intercept": 6, "coef_ssr_count": 6, "coef_load_factor": 6, "r2": 6, "n_obs": "i"},
    OLS,
    ("requested",),
)
def ols_delay(spark, folder):
    return measures.delay_regression(requested_loads(spark, folder))


@case(
    "ssr_delay_trend",
    {"slope": 6, "intercept": 6, "points": "i"},
    """(SELECT regr_slope(dep_delay_minutes, ssr_count) AS slope, regr_intercept(dep_delay_minutes, ssr_count) AS intercept,
        count(dep_delay_minutes) AS points FROM requested)""",
    ("requested",),
)
def ssr_delay_trend(spark, folder):
    return charts.trend_line(requested_loads(spark, folder), "ssr_count", "dep_delay_minutes")


def histogram_sql(source: str, column: str, bins: int) -> str:
    width = f"((hi - lo) / {bins})"
    return f"""(SELECT bin, lo + bin * {width} AS bin_start, count(*) AS rows
        FROM (SELECT least(CAST(floor(({column} - lo) / {width}) AS BIGINT), {bins - 1}) AS bin, lo, hi
        FROM {source}, (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}) WHERE {column} IS NOT NULL) GROUP BY bin, lo, hi)"""


HISTOGRAM_COLUMNS = {"bin": "i", "bin_start": 6, "rows": "i"}


@case("delay_histogram", HISTOGRAM_COLUMNS, histogram_sql("loads", "dep_delay_minutes", 50), ("loads",))
def delay_histogram(spark, folder):
    return charts.histogram(turn.with_delay(tables.flights(spark, folder, delays=True)), "dep_delay_minutes", 50)


@case("transfer_ratio_histogram", HISTOGRAM_COLUMNS, histogram_sql("bag_shares", "transfer_ratio", 40), ("bag_shares",))
def transfer_ratio_histogram(spark, folder):
    return charts.histogram(bags.bag_shares(tables.bags(spark, folder), KEY), "transfer_ratio", 40)


@case(
    "scatter_sample",
    {"flight_id": "i", "ground_time_delta": "i", "dep_delay_minutes": 9},
    "(SELECT * FROM loads ORDER BY (flight_id * 2654435761) % 4294967296, flight_id LIMIT 3000)",
    ("loads",),
)
def scatter_sample(spark, folder):
    measured = turn.with_ground_bands(turn.with_delay(tables.flights(spark, folder, delays=True)))
    mixed = (F.col("flight_id") * 2654435761) % 4294967296
    return charts.scatter_points(measured, ["flight_id", "ground_time_delta", "dep_delay_minutes"], mixed, KEY)


@case(
    "feature_coverage",
    {"category": "s", "implemented": "i", "known_flights": "i"},
    """(SELECT 'ground_time_constraints' AS category, 1 AS implemented, count(*) AS known_flights FROM master
        UNION ALL SELECT 'flight_specific_characteristics', 1, count(load_factor) FROM master
        UNION ALL SELECT 'passenger_service_needs', 1, count(*) FROM master
        UNION ALL SELECT 'additional_exploration', 1, count(*) FILTER (WHERE total_pax > 0) FROM master)""",
    ("master",),
)
def feature_coverage(spark, folder):
    return reports.feature_coverage(turn.with_extra_features(default_master(spark, folder)))


# Tuning -----------------------------------------------------------------------------------------

TUNED = SLICE


def tuning_design(spark, folder):
    """Scaled slice features, the difficult class as target, and a fold both engines can compute."""
    scored = slice_scored(spark, folder)
    table, _ = tuning.with_target(scored, "difficulty")
    return tuning.design_columns(table, TUNED).withColumn("fold", (F.col("flight_id") % 5).cast("int"))


@case(
    "global_minmax_scale",
    {"flight_id": "i", **{f"x_{name}": 9 for name in SLICE}},
    "(SELECT flight_id, "
    + ", ".join(
        f"coalesce((CAST({n} AS DOUBLE) - min(CAST({n} AS DOUBLE)) OVER ()) / nullif(max(CAST({n} AS DOUBLE)) OVER () - min(CAST({n} AS DOUBLE)) OVER (), 0), 0) AS x_{n}"
        for n in SLICE
    )
    + " FROM slice)",
    ("slice",),
)
def global_minmax_scale(spark, folder):
    return tuning.design_columns(staged_slice(spark, folder), SLICE)


@case(
    "simplex_projection",
    {"candidate": "s", "feature": "s", "weight": 6},
    f"""(SELECT candidate, feature, greatest(value - theta, 0) AS weight FROM (SELECT *, max(CASE WHEN value - shift > 0 THEN i END) OVER (PARTITION BY candidate) AS rho,
        max(CASE WHEN value - shift > 0 THEN struct_pack(i := i, shift := shift) END) OVER (PARTITION BY candidate).shift AS theta
        FROM (SELECT *, (running - 1) / i AS shift FROM (SELECT {DEST} AS candidate, feature, 8 * lift_vs_overall AS value,
        row_number() OVER (PARTITION BY {DEST} ORDER BY lift_vs_overall DESC, feature) AS i,
        sum(8 * lift_vs_overall) OVER (PARTITION BY {DEST} ORDER BY lift_vs_overall DESC, feature ROWS UNBOUNDED PRECEDING) AS running
        FROM ({lift_rows('scored')})))))""",
    ("scored",),
)
def simplex_projection(spark, folder):
    lifts = insights.destination_lifts(default_scored(spark, folder))
    candidates = lifts.select(
        F.col(DESTINATION).alias("candidate"), "feature", (8 * F.col("lift_vs_overall")).alias("value")
    )
    return tuning.simplex_projection(candidates)


def sum_name(name: str) -> str:
    return {"one": "1.0", "target": "target"}.get(name, f"{name}_scaled")


TARGETED = "(SELECT *, CASE WHEN difficulty_class = 'Difficult' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target, flight_id % 5 AS fold FROM slice_scored)"
NAMES = ["one", *SLICE, "target"]


def gram_sql(by: str, where: str = "") -> str:
    lead = f"{by}, " if by else ""
    pairs = [(a, b) for at, a in enumerate(NAMES) for b in NAMES[at:]]
    sums = ", ".join(f"sum(CAST({sum_name(a)} AS DOUBLE) * {sum_name(b)}) AS s{at}" for at, (a, b) in enumerate(pairs))
    cells = ", ".join(f"('{a}', '{b}', s{at})" for at, (a, b) in enumerate(pairs))
    group = f"GROUP BY {by}" if by else ""
    return f"SELECT {lead}i, j, s FROM (SELECT {lead}{sums} FROM {TARGETED} {where} {group}) g, LATERAL (VALUES {cells}) AS c (i, j, s)"


@case(
    "cv_fold_gram",
    {"fold": "i", "part": "s", "i": "s", "j": "s", "s": 4},
    f"""(SELECT fold, 'test' AS part, i, j, s FROM ({gram_sql('fold')})
        UNION ALL SELECT f.fold, 'train', i, j, sum(s) FROM ({gram_sql('fold')}) g JOIN (SELECT unnest(range(5)) AS fold) f ON f.fold <> g.fold GROUP BY 1, 3, 4)""",
    ("slice_scored",),
)
def cv_fold_gram(spark, folder):
    return tuning.fold_sums(tuning_design(spark, folder), TUNED)


def uniform_blend(prefix: str = "", suffix: str = "_scaled") -> str:
    return " + ".join(f"{prefix}{name}{suffix} * {number(1.0 / len(TUNED))}" for name in TUNED)


@case(
    "score_target_corr",
    {"candidate": "s", "corr": 6},
    f"(SELECT 'uniform' AS candidate, corr(target, {uniform_blend()}) AS corr FROM {TARGETED})",
    ("slice_scored",),
)
def score_target_corr(spark, folder):
    design = tuning_design(spark, folder).withColumn("part", F.lit("all"))
    covariance = tuning.covariances(stage(tuning.product_matrices(tuning.shifted(design, TUNED), TUNED, ["part"])), ["part"], TUNED)
    rows = [("uniform", name, 1.0 / len(TUNED)) for name in TUNED]
    uniform = spark.createDataFrame(rows, tuning.CANDIDATE_SCHEMA)
    return tuning.score_candidates(uniform, stage(covariance), ["part"])


@case(
    "score_auc",
    {"auc": 6, "positives": "i", "negatives": "i"},
    f"""(SELECT sum(p * (below + n / 2.0)) / (CAST(sum(p) AS DOUBLE) * sum(n)) AS auc, sum(p) AS positives, sum(n) AS negatives
        FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY points ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT CAST(round(({uniform_blend()}) * CAST(1000000000 AS DOUBLE)) AS BIGINT) AS points, CAST(sum(target) AS BIGINT) AS p,
        CAST(sum(1 - target) AS BIGINT) AS n FROM {TARGETED} GROUP BY 1)))""",
    ("slice_scored",),
)
def score_auc(spark, folder):
    weights = {name: 1.0 / len(TUNED) for name in TUNED}
    return tuning.rank_quality(tuning.blend(tuning_design(spark, folder), weights))


def start_mixes(names: list[str]) -> dict[str, dict[str, float]]:
    """The candidates a search starts from, written out again for the SQL."""
    total = sum(SQL_WEIGHTS[name] for name in names)
    mixes = {"uniform": {name: 1.0 / len(names) for name in names}, "default": {name: SQL_WEIGHTS[name] / total for name in names}}
    mixes |= {f"only:{name}": {name: 1.0} for name in names}
    return mixes | {f"mix:{a}+{b}": {a: 0.5, b: 0.5} for at, a in enumerate(names) for b in names[at + 1 :]}


def candidate_sql() -> str:
    mixes = start_mixes(TUNED)
    sums = [" + ".join(f"{name}_scaled * {number(weight)}" for name, weight in mix.items()) for mix in mixes.values()]
    columns = ", ".join(f"corr(target, {total}) AS c{at}" for at, total in enumerate(sums))
    cells = ", ".join(f"('{label}', c{at})" for at, label in enumerate(mixes))
    return f"""(SELECT fold, candidate, corr FROM (SELECT f.fold, {columns} FROM {TARGETED} t JOIN (SELECT unnest(range(5)) AS fold) f
        ON t.fold <> f.fold GROUP BY 1) g, LATERAL (VALUES {cells}) AS c (candidate, corr))"""


@case("candidate_weight_search", {"fold": "i", "candidate": "s", "corr": 6}, candidate_sql(), ("slice_scored",))
def candidate_weight_search(spark, folder):
    covariance = tuning.fold_covariances(tuning_design(spark, folder), TUNED).where("part = 'train'").drop("part")
    candidates = spark.createDataFrame(tuning.start_candidates(TUNED, DEFAULT_WEIGHTS), tuning.CANDIDATE_SCHEMA)
    return tuning.score_candidates(candidates, stage(covariance), ["fold"])


@case(
    "hash_folds",
    {"folds": "i", "rows": "i", "fair": "i", "stable": "i"},
    "(SELECT 5 AS folds, count(*) AS rows, 1 AS fair, 1 AS stable FROM orders)",
)
def hash_folds(spark, folder):
    """Folds of the key's hash: all rows in one of five folds of about a fifth each, and the same ones however rows lie."""
    flights = tables.flights(spark, folder).select("flight_id")
    once = tuning.with_fold(flights, KEY).select("flight_id", "fold")
    again = tuning.with_fold(flights.repartition(7, "flight_id"), KEY).select("flight_id", F.col("fold").alias("other"))
    sizes = once.join(again, "flight_id").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("fold") == F.col("other")).alias("same"))
    share = F.max(F.abs(F.col("n") / F.lit(flights.count()) - 0.2)) < 0.05
    return sizes.agg(
        F.count(F.lit(1)).alias("folds"), F.sum("n").alias("rows"), share.cast("int").alias("fair"), (F.sum("n") == F.sum("same")).cast("int").alias("stable")
    )


def gradient_sql(rows: str, auc: bool = False) -> str:
    """The gradient search as a recursive query: one row per fold, 400 steps on the covariances of the other folds' rows."""
    size = len(TUNED)
    values = ", ".join(f"{name}_scaled" for name in TUNED)
    square = ", ".join("[" + ", ".join(f"covar_pop({a}_scaled, {b}_scaled)" for b in TUNED) + "]" for a in TUNED)
    cross = ", ".join(f"covar_pop({name}_scaled, target)" for name in TUNED)
    image = "list_transform(square, lambda line: list_dot_product(line, w))"
    quality = "CASE WHEN list_dot_product(w, image) * var > 0 THEN list_dot_product(w, together) / sqrt(list_dot_product(w, image) * var) ELSE CAST('-Infinity' AS DOUBLE) END"
    even = f"list_transform(range({size}), lambda x: {number(1 / size)})"
    blend = " + ".join(f"w[{at + 1}] * {name}_scaled" for at, name in enumerate(TUNED))
    area = f"""(SELECT sum(p * (below + n / 2.0)) / (CAST(sum(p) AS DOUBLE) * sum(n)) FROM (
        SELECT *, coalesce(sum(n) OVER (ORDER BY points ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
            SELECT CAST(round(({blend}) * CAST(1000000000 AS DOUBLE)) AS BIGINT) AS points, CAST(sum(target) AS BIGINT) AS p, CAST(sum(1 - target) AS BIGINT) AS n
            FROM t JOIN mean ON true GROUP BY 1)))"""
    return f"""(WITH RECURSIVE t AS MATERIALIZED (SELECT fold, target, {values} FROM {rows}),
        known AS MATERIALIZED (SELECT f.fold, [{square}] AS square, [{cross}] AS together, var_pop(target) AS var
            FROM t JOIN (SELECT unnest(range(5)) AS fold) f ON t.fold <> f.fold GROUP BY 1),
        state AS (
            SELECT fold, 0 AS step, w, image, w AS best, {quality} AS reached FROM (SELECT *, {image} AS image FROM (SELECT *, {even} AS w FROM known))
            UNION ALL
            SELECT fold, step + 1, w, image, CASE WHEN q > reached THEN w ELSE best END, greatest(q, reached) FROM (SELECT *, {quality} AS q FROM (
                SELECT fold, step, best, reached, together, var, w, {image} AS image FROM (
                    SELECT fold, step, best, reached, square, together, var, list_transform(v, lambda x: greatest(x - shifts[len(list_filter(list_zip(falling, shifts), lambda z: z[1] > z[2]))], 0)) AS w FROM (
                        SELECT *, list_transform(range(1, {size + 1}), lambda i: (list_sum(falling[1:i]) - 1) / i) AS shifts FROM (
                            SELECT *, list_sort(v, 'DESC') AS falling FROM (
                                SELECT *, list_transform(list_zip(w, slope), lambda z: z[1] + {number(0.05)} * (z[2] - CASE WHEN z[1] > 0 THEN total / n ELSE (total + z[2]) / (n + 1) END)) AS v FROM (
                                    SELECT *, list_sum(list_transform(list_zip(w, slope), lambda z: CASE WHEN z[1] > 0 THEN z[2] ELSE CAST(0 AS DOUBLE) END)) AS total,
                                           len(list_filter(w, lambda x: x > 0)) AS n FROM (
                                        SELECT *, list_transform(list_zip(together, image), lambda z: (z[1] / sqrt(spread) - up * z[2] / (spread * sqrt(spread))) / sqrt(var)) AS slope FROM (
                                            SELECT s.*, k.square, k.together, k.var, list_dot_product(s.w, s.image) AS spread, list_dot_product(s.w, k.together) AS up
                                            FROM state s JOIN known k USING (fold) WHERE s.step < 400)))))))))
        ),
        found AS MATERIALIZED (SELECT fold, best AS w FROM state WHERE step = 400),
        mean AS MATERIALIZED (SELECT list(weight ORDER BY nth) AS w FROM (SELECT nth, sum(x) / 5 AS weight FROM (SELECT unnest(w) AS x, unnest(range({size})) AS nth FROM found) GROUP BY nth)),
        quality AS (SELECT avg(train) AS train_corr, avg(test) AS test_corr FROM (SELECT f.fold, corr(target, {blend}) FILTER (WHERE t.fold <> f.fold) AS train,
            corr(target, {blend}) FILTER (WHERE t.fold = f.fold) AS test FROM t JOIN found f ON true GROUP BY 1))
        SELECT feature, weight, train_corr, test_corr{', ' + area + ' AS auc' if auc else ''} FROM (
            SELECT unnest([{', '.join(f"'{name}'" for name in TUNED)}]) AS feature, unnest(w) AS weight FROM mean) JOIN quality ON true)"""


DELAYED = f"""(SELECT *, CAST(coalesce((epoch_us(actual_departure_datetime_local) - epoch_us({DEPARTURE})) / 60000000.0, 0) AS DOUBLE) AS target,
    flight_id % 5 AS fold FROM late_scaled)"""
TUNED_COLUMNS = {"feature": "s", "weight": 5, "train_corr": 6, "test_corr": 6}


@case("tuned_weights", TUNED_COLUMNS, gradient_sql(DELAYED), ("late_scaled",))
def tuned_weights(spark, folder):
    return reports.tune(stage(default_scored(spark, folder, delays=True)), SETTINGS, "delay", fold=F.col("flight_id") % 5)


@case(
    "tuned_weights_json",
    {"feature": "s", "weight": 5, "cv_score": 6, "held_out_score": 6, "auc": 6, "target": "s"},
    f"(SELECT feature, weight, train_corr AS cv_score, test_corr AS held_out_score, auc, 'difficulty' AS target FROM {gradient_sql(TARGETED, auc=True)})",
    ("slice_scored",),
)
def tuned_weights_json(spark, folder):
    """The weights as they stand in the JSON file that the tuning job writes."""
    path = scratch(spark, "weights")
    reports.tune(stage(slice_scored(spark, folder)), SETTINGS, "difficulty", path=path, fold=F.col("flight_id") % 5)
    weights = ", ".join(f"{name}: double" for name in TUNED)
    record = spark.read.schema(f"weights struct<{weights}>, cv_score double, held_out_score double, auc double, target string").json(path)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("feature"), F.col(f"weights.{name}").alias("weight")) for name in TUNED]))
    return record.select("cv_score", "held_out_score", "auc", "target", each.alias("w")).select("w.*", "cv_score", "held_out_score", "auc", "target")


def weighted(weights: str, share: float | None = None, name: str = "") -> str:
    """The weighted sum of the scaled features with weights in columns ``<weights>0…``, some share of it moved to one feature."""
    total = " + ".join(f"{weights}{at} * {feature}_scaled" for at, feature in enumerate(TUNED))
    return f"({total})" if share is None else f"({number(1 - share)} * ({total}) + {number(share)} * {name}_scaled)"


def search_sql() -> str:
    """The search of ``tuned_weights_candidates`` written out: the best start per fold, then two rounds of mixes with one feature."""
    mixes = start_mixes(TUNED)
    values = ", ".join(f"('{label}', {', '.join(number(mix.get(name, 0.0)) for name in TUNED)})" for label, mix in mixes.items())
    names = ", ".join(f"w{at}" for at in range(len(TUNED)))
    steps = [
        f"t AS MATERIALIZED (SELECT * FROM {TARGETED})",
        "f AS (SELECT unnest(range(5)) AS fold)",
        f"starts AS (SELECT * FROM {candidate_sql()})",
        "best0 AS (SELECT * FROM starts QUALIFY row_number() OVER (PARTITION BY fold ORDER BY corr DESC NULLS LAST, candidate) = 1)",
        f"weights0 AS MATERIALIZED (SELECT fold, {names} FROM best0 JOIN (VALUES {values}) AS v (candidate, {names}) USING (candidate))",
    ]
    for turn, share in enumerate((0.25, 0.125)):
        tried = [weighted("w"), *[weighted("w", share, name) for name in TUNED]]
        corrs = ", ".join(f"corr(target, {total}) AS c{at}" for at, total in enumerate(tried))
        cells = ", ".join([f"('keep:' || fold, -1, c0)", *[f"('mix:' || fold || ':{name}', {at}, c{at + 1})" for at, name in enumerate(TUNED)]])
        moved = ", ".join(f"CASE WHEN pick < 0 THEN w{at} ELSE {number(1 - share)} * w{at} + CASE WHEN pick = {at} THEN {number(share)} ELSE 0 END END AS w{at}" for at in range(len(TUNED)))
        steps += [
            f"""tried{turn + 1} AS (SELECT fold, candidate, pick, corr FROM (SELECT w.fold, {corrs} FROM t JOIN weights{turn} w ON t.fold <> w.fold GROUP BY 1) g,
                LATERAL (VALUES {cells}) AS c (candidate, pick, corr))""",
            f"""best{turn + 1} AS (SELECT * FROM tried{turn + 1}
                QUALIFY row_number() OVER (PARTITION BY fold ORDER BY corr DESC NULLS LAST, candidate) = 1)""",
            f"weights{turn + 1} AS MATERIALIZED (SELECT fold, {moved} FROM weights{turn} JOIN best{turn + 1} USING (fold))",
        ]
    ends = f"""(SELECT avg(train) AS train_corr, avg(test) AS test_corr FROM (SELECT w.fold, corr(target, {weighted('w')}) FILTER (WHERE t.fold <> w.fold) AS train,
        corr(target, {weighted('w')}) FILTER (WHERE t.fold = w.fold) AS test FROM t JOIN weights2 w ON true GROUP BY 1))"""
    means = " UNION ALL ".join(f"SELECT '{name}' AS feature, sum(w{at}) / 5 AS weight FROM weights2" for at, name in enumerate(TUNED))
    return f"(WITH {', '.join(steps)} SELECT feature, weight, train_corr, test_corr FROM ({means}) JOIN {ends} ON true)"


@case("tuned_weights_candidates", {"feature": "s", "weight": 6, "train_corr": 6, "test_corr": 6}, search_sql(), ("slice_scored",))
def tuned_weights_candidates(spark, folder):
    return tuning.tune_weights(tuning_design(spark, folder), TUNED, DEFAULT_WEIGHTS, "candidates")


@case(
    "tuned_weights_auc",
    {**TUNED_COLUMNS, "auc": 6},
    f"(SELECT * FROM {gradient_sql(TARGETED, auc=True)} ORDER BY weight DESC, feature LIMIT 15)",
    ("slice_scored",),
)
def tuned_weights_auc(spark, folder):
    return tuning.top_weights(reports.tune(stage(slice_scored(spark, folder)), SETTINGS, "difficulty", fold=F.col("flight_id") % 5))
