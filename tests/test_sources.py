import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from skyload.config import DAY
from skyload.functions.parsing import parse_date, parse_utc_timestamp
from skyload.operators.staging import shared_folder, stage
from skyload.sources import sinks
from skyload.sources.tables import LAYOUTS, input_counts, read_csv, read_inputs, read_table, read_weather


def test_dates_in_both_styles(spark):
    texts = ["2025-08-01", "8/1/2025", "2025-08-01 10:30:00", " 2025-08-01 ", "8/1/2025 08:15", "8/1/2025 8:15:30", "13/45/2025", "soon", None]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    found = [row[0] for row in df.orderBy("n").select(parse_date(F.col("t"))).collect()]
    assert found == [date(2025, 8, 1)] * 6 + [None] * 3


def test_issue_times_move_to_utc(spark):
    texts = ["2025-08-01 10:00:00", "2025-08-01T10:00:00Z", "2025-08-01 10:00:00+02:00", "2025-08-01", "x"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").orderBy("n").select(parse_utc_timestamp(F.col("t")))
    expected = [datetime(2025, 8, 1, 10), datetime(2025, 8, 1, 10), datetime(2025, 8, 1, 8), datetime(2025, 8, 1), None]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/Chicago"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [row[0] for row in df.collect()] == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


FLIGHT_CSV = """ company_id ,flight_number, scheduled_departure_date_local,scheduled_arrival_station_code,total_seats,scheduled_departure_datetime_local,note
UA,1001,2025-08-01,MIA,180,2025-08-01 08:15:00,a
UA,1002.0,8/1/2025,NA,n/a,not a time,null
,,,,,,
"""


def test_flight_file(spark, tmp_path):
    (tmp_path / "flights.csv").write_text(FLIGHT_CSV)
    df = read_table(spark, str(tmp_path / "flights.csv"), "flights")
    assert [name for name, _ in df.dtypes][:3] == ["company_id", "flight_number", DAY]
    kinds = dict(df.dtypes)
    assert (kinds["flight_number"], kinds[DAY], kinds["total_seats"], kinds["scheduled_departure_datetime_local"], kinds["note"]) == (
        "bigint", "date", "int", "timestamp_ntz", "string"
    )
    rows = sorted((tuple(row) for row in df.collect() if row["company_id"]), key=str)
    assert rows[0] == ("UA", 1001, date(2025, 8, 1), "MIA", 180, datetime(2025, 8, 1, 8, 15), "a")
    assert rows[1] == ("UA", 1002, date(2025, 8, 1), None, None, None, None)


def test_quoted_fields_and_odd_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,n,x\n"needs ""WCHR, ramp"" at gate",12, NaN\n"two\nlines",13,Infinity\nplain,14,-1.5\n')
    df = read_csv(spark, str(tmp_path / "a.csv"), {"n": "bigint", "x": "double"})
    assert sorted(map(tuple, df.collect()), key=str) == [('needs "WCHR, ramp" at gate', 12, None), ("plain", 14, -1.5), ("two\nlines", 13, None)]
    sinks.write_table(df, str(tmp_path / "out"), "csv")
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "out"), {"n": "bigint", "x": "double"}).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_typed_numbers_that_are_none(spark, tmp_path):
    spark.createDataFrame([("A", float("nan")), ("B", float("inf")), ("C", 2.0)], "station_code string, weather_severity_index double").withColumn(
        "observation_time", F.lit("2025-08-01 08:00:00").cast("timestamp_ntz")).write.parquet(str(tmp_path / "w"))
    found = {r["station_code"]: r["weather_severity_index"] for r in read_table(spark, str(tmp_path / "w"), "weather", "parquet").collect()}
    assert found == {"A": None, "B": None, "C": 2.0}


def test_missing_columns_are_named(spark, tmp_path):
    (tmp_path / "airports.csv").write_text("airport_iata_code\nMIA\n")
    with pytest.raises(ValueError, match="iso_country_code"):
        read_table(spark, str(tmp_path / "airports.csv"), "airports")


def test_weather_is_optional(spark, tmp_path):
    assert read_weather(spark, None) is None
    assert read_weather(spark, str(tmp_path / "none.csv")) is None
    (tmp_path / "bad.csv").write_text("station_code,temperature\nORD,3\n")
    assert read_weather(spark, str(tmp_path / "bad.csv")) is None
    (tmp_path / "good.csv").write_text("station_code, observation_time,weather_severity_index\nORD,2025-08-01T08:00:00-05:00,0.4\n")
    row = read_weather(spark, str(tmp_path / "good.csv")).first()
    assert tuple(row) == ("ORD", datetime(2025, 8, 1, 8), 0.4)


def test_all_inputs(spark, tmp_path):
    (tmp_path / "flights.csv").write_text(FLIGHT_CSV)
    (tmp_path / "bags.csv").write_text("company_id,flight_number,scheduled_departure_date_local,bag_type\nUA,1001,8/1/2025,Origin\n")
    (tmp_path / "bookings.csv").write_text(
        "company_id,flight_number,scheduled_departure_date_local,record_locator,total_pax,is_child,is_stroller_user,lap_child_count\nUA,1001,2025-08-01,L,2,Y,N,0\n"
    )
    (tmp_path / "remarks.csv").write_text("record_locator,special_service_request\nL,WCHR\n")
    (tmp_path / "airports.csv").write_text("airport_iata_code,iso_country_code\nMIA,US\n")
    paths = {name: str(tmp_path / f"{name}.csv") for name in ("flights", "bags", "bookings", "remarks", "airports", "weather")}
    inputs = read_inputs(spark, paths)
    assert inputs.weather is None
    assert inputs.bags.first()[DAY] == date(2025, 8, 1)
    counts = {tuple(row) for row in input_counts(inputs).collect()}
    assert {("flights", 3, 1), ("bags", 1, 0), ("remarks", 1, 0)} <= counts and len(counts) == 5
    sinks.write_table(inputs.flights, str(tmp_path / "flights.parquet"))
    again = read_table(spark, str(tmp_path / "flights.parquet"), "flights", "parquet")
    assert again.dtypes == inputs.flights.dtypes
    assert read_csv(spark, paths["airports"]).columns == list(LAYOUTS["airports"])


def scores(spark, days):
    return spark.createDataFrame([(date(2025, 8, d), d * 1.0, "Easy") for d in days for _ in range(3)], f"{DAY} date, difficulty_score double, difficulty_class string")


def test_one_day_of_scores_can_be_replaced(spark, tmp_path):
    path = str(tmp_path / "scores")
    sinks.write_scores(scores(spark, [1, 2, 3]), path)
    sinks.write_scores(scores(spark, [2]).withColumn("difficulty_class", F.lit("Medium")), path)
    found = {(row[DAY].day, row["difficulty_class"]): row["n"] for row in sinks.read_scores(spark, path).groupBy(DAY, "difficulty_class").agg(F.count("*").alias("n")).collect()}
    assert found == {(1, "Easy"): 3, (2, "Medium"): 3, (3, "Easy"): 3}


@pytest.mark.parametrize("per", ["day", "month"])
def test_scores_of_some_days_read_only_their_folders(spark, tmp_path, per):
    days = [date(2025, 8, 1), date(2025, 8, 2), date(2025, 9, 1), date(2025, 10, 1)]
    scored = spark.createDataFrame([(day, "Easy", n) for n, day in enumerate(days)] + [(None, "Easy", 9)], f"{DAY} date, difficulty_class string, n int")
    sinks.write_scores(scored, str(tmp_path), per=per)
    found = sinks.read_scores(spark, str(tmp_path), days=["2025-08-02", "2025-10-01", "2030-01-01"])
    assert sorted(row["n"] for row in found.collect()) == [1, 3]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and f"score_{per}" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_scores_as_csv(spark, tmp_path):
    path = str(tmp_path / "scores")
    sinks.write_table(scores(spark, [1]), path, "csv")
    df = sinks.read_scores(spark, path, source="csv")
    assert dict(df.dtypes) == {DAY: "date", "difficulty_score": "double", "difficulty_class": "string"}
    assert df.first()["difficulty_score"] == 1.0 and df.count() == 3
    with pytest.raises(ValueError, match="daily_rank"):
        sinks.read_scores(spark, path, source="csv", needed=["daily_rank"])


def test_weights_as_json(spark, tmp_path):
    tuned = spark.createDataFrame([("a", 0.7, 0.5, 0.4), ("b", 0.3, 0.5, 0.4)], "feature string, weight double, train_corr double, test_corr double")
    sinks.write_weights(tuned, str(tmp_path / "weights"), "delay")
    text = "".join(file.read_text() for file in (tmp_path / "weights").glob("*.json"))
    assert json.loads(text) == {"weights": {"a": 0.7, "b": 0.3}, "cv_score": 0.5, "held_out_score": 0.4, "target": "delay"}


def test_staged_tables_live_in_the_shared_folder(spark):
    df = stage(spark.range(5))
    assert df.count() == 5
    assert shared_folder(spark).split(":")[-1] in df.inputFiles()[0]
