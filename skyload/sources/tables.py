"""Reading the input tables: layouts, cleaning, typing, optional sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyload.config import DAY, FLIGHT_KEY
from skyload.functions.parsing import finite, parse_as, text_or_null

# Column kinds of the input tables. Other columns stay text.
LAYOUTS = {
    "flights": {
        "company_id": "string",
        "flight_number": "bigint",
        "scheduled_departure_date_local": "date",
        "scheduled_departure_station_code": "string",
        "scheduled_arrival_station_code": "string",
        "scheduled_departure_datetime_local": "timestamp",
        "scheduled_arrival_datetime_local": "timestamp",
        "actual_departure_datetime_local": "timestamp",
        "actual_arrival_datetime_local": "timestamp",
        "total_seats": "int",
        "fleet_type": "string",
        "carrier": "string",
        "scheduled_ground_time_minutes": "int",
        "actual_ground_time_minutes": "int",
        "minimum_turn_minutes": "int",
        "weather_severity_index": "double",
    },
    "bags": {
        "company_id": "string",
        "flight_number": "bigint",
        "scheduled_departure_date_local": "date",
        "bag_tag_unique_number": "string",
        "bag_tag_issue_datetime": "timestamp_utc",
        "bag_issue_datetime": "timestamp_utc",
        "bag_tag_issue_date": "timestamp_utc",
        "bag_type": "string",
    },
    "bookings": {
        "company_id": "string",
        "flight_number": "bigint",
        "scheduled_departure_date_local": "date",
        "record_locator": "string",
        "pnr_creation_date": "timestamp",
        "total_pax": "int",
        "lap_child_count": "int",
        "is_child": "string",
        "basic_economy_pax": "int",
        "is_stroller_user": "string",
    },
    "remarks": {
        "record_locator": "string",
        "pnr_creation_date": "timestamp",
        "flight_number": "string",
        "special_service_request": "string",
    },
    "airports": {"airport_iata_code": "string", "iso_country_code": "string"},
    "weather": {
        "station_code": "string",
        "observation_time": "timestamp",
        "weather_severity_index": "double",
    },
}

# Quoted fields as most programs write them: a quote inside is doubled, line breaks may occur.
CSV_STYLE = {"quote": '"', "escape": '"', "multiLine": True}

# Columns without which a table is of no use.
REQUIRED = {
    "flights": {DAY, "flight_number", "scheduled_arrival_station_code", "total_seats"},
    "bags": set(),
    "bookings": {"record_locator", "total_pax", "is_child", "is_stroller_user", "lap_child_count"},
    "remarks": {"record_locator"},
    "airports": {"airport_iata_code", "iso_country_code"},
    "weather": {"station_code", "observation_time", "weather_severity_index"},
}


@dataclass(frozen=True)
class Inputs:
    """The input tables; the weather may be missing."""

    flights: DataFrame
    bags: DataFrame
    bookings: DataFrame
    remarks: DataFrame
    airports: DataFrame
    weather: DataFrame | None = None


def clean_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def typed(df: DataFrame, layout: Mapping[str, str]) -> DataFrame:
    """Text columns to the kinds of the layout. Columns already typed keep their type; days become dates, NaN and infinity null."""
    columns = []
    for name, kind in df.dtypes:
        value = F.col(name)
        if kind == "string":
            value = parse_as(text_or_null(value), layout.get(name, "string"))
        elif layout.get(name) == "date":
            value = value.cast("date")
        elif kind in ("double", "float"):
            value = finite(value)
        columns.append(value.alias(name))
    return df.select(*columns)


def read_csv(spark: SparkSession, path: str, layout: Mapping[str, str] | None = None) -> DataFrame:
    """Delimited file with a header row. Everything is read as text, so no pass is spent on guessing types.

    Fields may be quoted and then hold commas, line breaks and doubled quotes. A file with line breaks in fields cannot be
    split, so one file is one task: give large inputs as Parquet, or as many files.
    """
    raw = spark.read.options(**CSV_STYLE).csv(path, header=True, inferSchema=False)
    return typed(clean_headers(raw), layout or {})


def read_table(spark: SparkSession, path: str, table: str, source: str = "csv") -> DataFrame:
    """One input table from CSV, or from a typed format such as Parquet or ORC."""
    if source == "csv":
        df = read_csv(spark, path, LAYOUTS[table])
    else:
        df = typed(clean_headers(spark.read.format(source).load(path)), LAYOUTS[table])
    missing = sorted(REQUIRED[table] - set(df.columns))
    if missing:
        raise ValueError(f"table {table} lacks columns {missing}")
    return df


def read_weather(spark: SparkSession, path: str | None, source: str = "csv") -> DataFrame | None:
    """The weather table, or None if there is no usable one."""
    if path is None:
        return None
    try:
        return read_table(spark, path, "weather", source)
    except (AnalysisException, ValueError):
        return None


def read_inputs(spark: SparkSession, paths: Mapping[str, str], source: str = "csv") -> Inputs:
    """All tables by name; ``weather`` may be left out."""
    tables = {f.name: read_table(spark, paths[f.name], f.name, source) for f in fields(Inputs) if f.name != "weather"}
    return Inputs(**tables, weather=read_weather(spark, paths.get("weather"), source))


def row_counts(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(table_name, rows, rows_without_key) for each table; the last are the rows no join can match."""
    result = None
    for name, df in tables.items():
        missing = F.lit(False)
        for column in (keys or {}).get(name, ()):
            missing = missing | F.col(column).isNull()
        one = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(missing).alias("rows_without_key")).select(
            F.lit(name).alias("table_name"), "rows", "rows_without_key"
        )
        result = one if result is None else result.unionByName(one)
    return result


def input_counts(inputs: Inputs, key: Sequence[str] = FLIGHT_KEY) -> DataFrame:
    """:func:`row_counts` of the input tables."""
    keys = {
        "flights": key,
        "bags": key,
        "bookings": [*key, "record_locator"],
        "remarks": ["record_locator"],
        "airports": ["airport_iata_code"],
        "weather": ["station_code", "observation_time"],
    }
    found = {f.name: getattr(inputs, f.name) for f in fields(Inputs)}
    return row_counts({name: df for name, df in found.items() if df is not None}, keys)
