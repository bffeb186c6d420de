import contextlib
import io
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from helpers import BAGS, BOOKINGS, FLIGHTS, REMARKS, airline, flight_row, rounded
from skyload.config import DAY, FLIGHT_KEY, FULL_WEIGHTS, Settings
from skyload.operators.bags import bag_counts, bag_features, bag_shares
from skyload.operators.context import with_aircraft, with_country, with_slot_congestion, with_weather
from skyload.operators.passengers import passenger_features, with_booking_lead, with_load
from skyload.operators.service import service_features
from skyload.operators.turn import with_delay, with_extra_features, with_ground_bands, with_turn_features
from skyload.plans.features import build_features
from skyload.sources.tables import Inputs

DAY1 = date(2025, 8, 1)


def by_number(df, *names):
    return {row["flight_number"]: tuple(row[name] for name in names) for row in df.collect()}


def test_booking_lead_is_in_whole_days(spark):
    """Ten in the morning before the departure day is no full day ahead."""
    made = [datetime(2025, 7, 31, 10), datetime(2025, 7, 31), datetime(2025, 8, 1, 0, 1), None]
    df = spark.createDataFrame([(n, DAY1, t) for n, t in enumerate(made)], f"n int, {DAY} date, pnr_creation_date timestamp_ntz")
    result = [(row["booking_lead_days"], row["late_booking_flag"]) for row in with_booking_lead(df).orderBy("n").collect()]
    assert result == [(0, 1), (1, 1), (-1, 1), (None, 0)]


def booking(number, locator, made, pax, lap=0, child="N", economy=0, stroller="N", day=DAY1):
    return ("UA", number, day, locator, made, pax, lap, child, economy, stroller)


def test_passenger_features(spark):
    made = lambda days: datetime(2025, 8, 1 - days) if days < 1 else datetime(2025, 7, 32 - days)
    table = [
        booking(1, "A", made(1), 2, 1, "Y", 1),
        booking(1, "B", made(10), 3, 0, None, 2, "Y"),
        booking(1, "B", made(10), 3, 0, "N", 0, "Y"),
        booking(1, "C", None, None, None, "N", None),
        booking(2, "D", None, None, None, "Y", None),
        booking(3, "E", made(1), 1, day=None),
    ]
    result = passenger_features(spark.createDataFrame(table, BOOKINGS))
    names = ("total_pax", "basic_economy_pax", "children", "stroller_users", "lap_children", "booking_lead_days_mean",
             "booking_lead_days_median", "late_booking_ratio")
    assert by_number(result, *names) == {1: (8, 3, 1, 2, 1, 7.0, 10.0, 0.25), 2: (0, 0, 1, 0, 0, None, None, 0.0)}


def test_load(spark):
    df = spark.createDataFrame([(1, 50, 100, 20), (2, 0, 100, 0), (3, None, 0, None)], "flight_number int, total_pax int, total_seats int, basic_economy_pax int")
    assert by_number(with_load(df), "total_pax", "load_factor", "basic_economy_ratio") == {
        1: (50, 0.5, 0.4), 2: (0, 0.0, 0.0), 3: (0, None, 0.0)
    }


def bag(number, kind, issued=None, day=DAY1):
    return ("UA", number, day, "t", issued, kind)


def test_bag_counts(spark):
    table = [bag(1, "Origin"), bag(1, "Checked"), bag(1, "Transfer"), bag(1, "Hot Transfer"), bag(1, "Crew"), bag(2, "Crew"), bag(3, "Origin", day=None)]
    df = spark.createDataFrame(table, BAGS)
    assert by_number(bag_counts(df), "total_bags", "total_transfer_bags", "hot_transfer_count", "transfer_ratio") == {1: (4, 2, 1, 0.5), 2: (0, 0, 0, None)}
    assert by_number(bag_shares(df), "total_bags", "transfer_ratio") == {1: (3, 1 / 3), 2: (0, None)}
    assert by_number(bag_shares(df.drop("bag_type")), "total_bags", "transfer_ratio") == {1: (0, None), 2: (0, None)}


@pytest.mark.parametrize("limit", [None, 2])
def test_bag_timing(spark, limit):
    """Bags at, before and after departure, without a time, of unknown flights, of a flight listed with two times."""
    unknown = list(flight_row("UA", 2, DAY1))
    unknown[5] = None
    flights = [tuple(unknown), flight_row("UA", 1, DAY1, hour=8, minute=0), flight_row("UA", 2, DAY1, hour=8, minute=0), flight_row("UA", 2, DAY1, hour=10, minute=0),
               flight_row("UA", 2, DAY1, hour=10, minute=0)]
    at = lambda hour: datetime(2025, 8, 1, hour)
    table = [bag(1, "Origin", at(2)), bag(1, "Origin", at(2)), bag(1, "Transfer", at(8)), bag(1, "Origin", None),
             bag(2, "Origin", at(9)), bag(2, "Transfer", at(4)), bag(9, "Origin", at(4))]
    result = bag_features(spark.createDataFrame(table, BAGS), spark.createDataFrame(flights, FLIGHTS), limit=limit)
    found = by_number(result, "total_bags", "bag_issue_lead_mean", "bag_late_issue_ratio")
    assert found[1] == (4, pytest.approx((0.25 + 0.25 + 0) / 3), 0.25)
    assert found[2] == (2, pytest.approx((-1 + 1 + 4 + 6) / 4 / 24), pytest.approx(1 / 6))
    assert found[9] == (1, 0.0, 0.0)


@pytest.mark.parametrize("limit", [None, 1])
def test_service_requests(spark, limit):
    """Two remarks of a booking with two flights: two each, four each when fanned out."""
    bookings = [booking(1, "A", None, 1), booking(1, "A", None, 1), booking(2, "A", None, 1), booking(3, "B", None, 1), booking(4, None, None, 1)]
    remarks = [("A", None, "1", "carpet"), ("A", None, "2", "Wchr"), (None, None, "4", "WCHR"), ("Z", None, "1", "WCHR"), ("B", None, "x", None)]
    b, r = spark.createDataFrame(bookings, BOOKINGS), spark.createDataFrame(remarks, REMARKS)
    names = ("ssr_count", "ssr_mobility_count", "ssr_special_handling_count")
    assert by_number(service_features(b, r, limit=limit), *names) == {1: (2, 1, 1), 2: (2, 1, 1), 3: (1, 0, 0)}
    assert by_number(service_features(b, r, mode="fanout", limit=limit), *names) == {1: (4, 2, 2), 2: (4, 2, 2), 3: (1, 0, 0)}
    assert by_number(service_features(b, r, mode="locator_flight", limit=limit), *names) == {1: (1, 0, 1), 2: (1, 1, 0)}
    assert by_number(service_features(b, r.drop("special_service_request")), *names)[1] == (2, 0, 0)
    with pytest.raises(ValueError):
        service_features(b, r, mode="guess")


def test_bags_of_a_flight_with_very_many_departure_times(spark):
    """100,000 departure times against 100,000 bags of one flight: no list of them, no task with all of them."""
    size, start = 100_000, datetime(2025, 8, 1)
    moment = lambda seconds: F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    key = [F.lit("UA").alias("company_id"), F.lit(1).cast("bigint").alias("flight_number"), F.lit(DAY1).alias("scheduled_departure_date_local")]
    flights = spark.range(size).select(*key, moment(F.col("id") * 3).alias("scheduled_departure_datetime_local"))
    bags = spark.range(size).select(*key, F.lit("Origin").alias("bag_type"), moment((F.col("id") * 7919) % (3 * size) - 50).alias("bag_tag_issue_datetime"))
    df = bag_features(bags, flights)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in text and "collect_set" not in text
    found = df.first()
    issued = [n * 7919 % (3 * size) - 50 for n in range(size)]
    late = sum(min(max(i // 3 + 1, 0), size) for i in issued)
    assert found["total_bags"] == size and found["bag_late_issue_ratio"] == pytest.approx(late / size**2, abs=1e-12)
    assert found["bag_issue_lead_mean"] == pytest.approx((3 * (size - 1) / 2 - sum(issued) / size) / 86400, abs=1e-9)


def test_turn_features(spark):
    df = spark.createDataFrame([(1, 40, 30, 50), (2, 60, 60, 50), (3, None, None, 50), (4, 10, 10, 0)],
                               "flight_number int, scheduled_ground_time_minutes int, actual_ground_time_minutes int, minimum_turn_minutes int")
    assert by_number(with_turn_features(df), "ground_time_pressure", "actual_turn_deficit", "turn_deficit_ratio") == {
        1: (10, 20, 0.6), 2: (0, 0, 1.2), 3: (0, 0, 0.0), 4: (0, 0, 0.0)
    }
    assert by_number(with_ground_bands(df), "ground_time_delta", "at_or_below_min_turn", "within_5_min_above_min") == {
        1: (-10, 1, 0), 2: (10, 0, 0), 3: (None, 0, 0), 4: (10, 0, 0)
    }


def test_size_bands_close_on_the_right(spark):
    df = spark.createDataFrame([(n, seats) for n, seats in enumerate([0, 70, 71, 150, 250, 251, -1, None])], "n int, total_seats int")
    found = [row["aircraft_size_category"] for row in with_extra_features(df).orderBy("n").collect()]
    assert found == ["Regional", "Regional", "Narrowbody", "Narrowbody", "Large Narrowbody", "Widebody", None, None]


def test_aircraft_and_country(spark):
    df = spark.createDataFrame([(1, 249, "B787", "MIA"), (2, 250, None, "LHR"), (3, None, "738", "XXX"), (4, 100, "a330", None)],
                               "flight_number int, total_seats int, fleet_type string, scheduled_arrival_station_code string")
    assert by_number(with_aircraft(df), "widebody_flag") == {1: (1,), 2: (1,), 3: (0,), 4: (1,)}
    airports = spark.createDataFrame([("MIA", "US"), ("MIA", "US"), ("LHR", "GB"), (None, "US")], "airport_iata_code string, iso_country_code string")
    for small in (None, 0):
        assert by_number(with_country(df, airports, small=small), "is_international") == {1: (0,), 2: (1,), 3: (1,), 4: (1,)}


def test_delay_keeps_seconds(spark):
    df = spark.createDataFrame([(1, datetime(2025, 3, 9, 1, 59), datetime(2025, 3, 9, 3, 0, 30)), (2, None, datetime(2025, 3, 9))],
                               "flight_number int, scheduled_departure_datetime_local timestamp_ntz, actual_departure_datetime_local timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
    try:
        assert by_number(with_delay(df), "dep_delay_minutes") == {1: (61.5,), 2: (None,)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert by_number(with_delay(df.drop("actual_departure_datetime_local")), "dep_delay_minutes") == {1: (None,), 2: (None,)}


def test_weather_demo(spark):
    flights = spark.createDataFrame([flight_row("UA", 1001, DAY1), flight_row("UA", 1002, DAY1, hour=9, minute=45), flight_row("UA", 2001, DAY1, origin="MIA", minute=20),
                                     flight_row("UA", 3001, DAY1, origin="SFO")], FLIGHTS)
    seen = [("ORD", 8, 0, 0.10), ("ORD", 9, 0, 0.30), ("ORD", 9, 59, 0.50), ("ORD", 10, 0, 0.80), ("MIA", 8, 0, 0.20), ("MIA", 9, 0, 0.30), (None, 8, 0, 9.0)]
    weather = spark.createDataFrame([(s, datetime(2025, 8, 1, h, m), v) for s, h, m, v in seen], "station_code string, observation_time timestamp_ntz, weather_severity_index double")
    expected = {1001: (0.10,), 1002: (pytest.approx(0.40),), 2001: (0.20,), 3001: (0.0,)}
    assert by_number(with_weather(flights, weather), "weather_severity_index") == expected
    again = flights.withColumn("weather_severity_index", F.lit(5.0))
    assert by_number(with_weather(again, weather, limit=1, small=0), "weather_severity_index") == expected
    assert set(by_number(with_weather(again, None), "weather_severity_index").values()) == {(0.0,)}
    assert set(by_number(with_weather(again, weather.drop("observation_time")), "weather_severity_index").values()) == {(0.0,)}


def test_slot_congestion(spark):
    flights = spark.createDataFrame(
        [flight_row("UA", 1, DAY1), flight_row("UA", 2, DAY1, minute=50), flight_row("UA", 3, date(2025, 8, 2)), flight_row("UA", 4, DAY1, hour=9),
         flight_row("UA", 5, DAY1, origin=None)], FLIGHTS)
    assert by_number(with_slot_congestion(flights), "slot_congestion_count") == {1: (3,), 2: (3,), 3: (3,), 4: (1,), 5: (None,)}
    per_date = {1: (2,), 2: (2,), 3: (1,), 4: (1,), 5: (None,)}
    assert by_number(with_slot_congestion(flights, per_date=True), "slot_congestion_count") == per_date
    assert by_number(with_slot_congestion(flights, per_date=True, limit=1, small=0), "slot_congestion_count") == per_date


@pytest.mark.parametrize("limit", [None, 3])
def test_all_features(spark, limit):
    """Every weighted feature but the baseline is there, one row per flight, whatever the join strategy."""
    inputs = airline(spark)
    master = build_features(inputs, Settings(), limit=limit)
    assert set(FULL_WEIGHTS) - set(master.columns) == {"destination_base_difficulty"}
    assert master.count() == inputs.flights.count()
    assert master.select(*FLIGHT_KEY).distinct().count() == inputs.flights.count()
    assert rounded(master) == rounded(build_features(inputs, Settings()))


def test_features_of_repeated_flight_keys(spark):
    """A flight listed many times gets its features on every listing."""
    inputs = airline(spark, days=2, numbers=3)
    many = inputs.flights.unionByName(inputs.flights.where("flight_number = 1002").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(40)))).drop("n"))
    master = build_features(Inputs(many, inputs.bags, inputs.bookings, inputs.remarks, inputs.airports), limit=10)
    assert master.count() == many.count()
    found = master.where("flight_number = 1002").groupBy(DAY).agg(F.countDistinct("total_pax", "total_bags", "ssr_count").alias("n")).collect()
    assert [row["n"] for row in found] == [1, 1]


def test_bags_are_counted_once(spark, tmp_path):
    """Only the bags of flights with several departure times are counted again; the plan that remains reads all bags once."""
    table = airline(spark)
    table.bags.write.parquet(f"{tmp_path}/bags")
    bags = spark.read.parquet(f"{tmp_path}/bags")
    key = ["company_id", "flight_number", "scheduled_departure_date_local"]
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        bag_features(bags, table.flights, key).explain()
    assert sum("FileScan" in line and "bag_type" in line for line in text.getvalue().splitlines()) == 1
    assert rounded(bag_features(bags, table.flights, key)) == rounded(bag_features(table.bags, table.flights, key))
