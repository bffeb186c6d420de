import glob
import random
import statistics
from datetime import date, timedelta

import pytest
from helpers import rounded
from pyspark.sql import functions as F

from skyload.config import DAY, DESTINATION
from skyload.operators import spread
from skyload.operators.history import daily_destinations, destination_baseline, with_destination_baseline, with_volatility
from skyload.operators.staging import STAGED

FIRST = date(2025, 1, 1)
SCHEMA = f"id int, flight_number string, {DAY} date, load_factor double, ground_time_pressure double"


def test_trailing_deviation_example(spark):
    values = [None, 1, 5, 2, None, 9, 4]
    table = [(n, "a", FIRST + timedelta(days=n), None if v is None else float(v), 0.0) for n, v in enumerate(values)]
    result = with_volatility(spark.createDataFrame(table, SCHEMA)).orderBy("id").collect()
    expected = [0, 0, 0, 2.8284, 2.0817, 2.0817, 3.594]
    assert [round(row["load_factor_volatility"], 4) for row in result] == expected
    assert {row["ground_time_pressure_volatility"] for row in result} == {0.0}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limit", [10, 25, 150, None])
def test_large_groups_cut_in_chunks(spark, seed, limit):
    """Chunks with carried rows give what one window gives: busy days, gaps, missing days and groups."""
    source = random.Random(seed)
    table = []
    for n in range(400):
        group = source.choice(["hot", "hot", "hot", "x", "y", None])
        day = source.choice([None, *[FIRST + timedelta(days=source.choice([0, 3, 3, 3, source.randint(0, 60)]))] * 9])
        value = source.choice([None, source.random(), source.random()])
        table.append((n, group, day, value, float(n % 7)))
    df = spark.createDataFrame(table, SCHEMA)
    result = {row["id"]: row for row in with_volatility(df, ties=["id"], limit=limit).collect()}
    assert len(result) == len(table)
    for group in ("hot", "x", "y"):
        ordered = sorted((r for r in table if r[1] == group), key=lambda r: (r[2] or date.min, r[0]))
        for at, row in enumerate(ordered):
            for place, name in ((3, "load_factor"), (4, "ground_time_pressure")):
                seen = [r[place] for r in ordered[max(at - 5, 0) : at] if r[place] is not None]
                expected = statistics.stdev(seen) if len(seen) > 1 else 0.0
                assert result[row[0]][f"{name}_volatility"] == pytest.approx(expected, abs=1e-9)
    assert all(result[row[0]]["load_factor_volatility"] == 0.0 for row in table if row[1] is None)


def test_without_flight_number(spark):
    df = spark.createDataFrame([(1, 0.5, 3.0)], "id int, load_factor double, ground_time_pressure double")
    assert with_volatility(df).first()["load_factor_volatility"] == 0.0


def scored(spark, table):
    return spark.createDataFrame(table, f"{DESTINATION} string, {DAY} date, difficulty_class string, difficulty_score double")


def test_baseline_rows_and_calendar(spark):
    """Days 0, 1 and 10 with flights: the row frame looks back over the gap, the calendar frame does not."""
    days = {0: 4, 1: 3, 10: 2}
    table = [("MIA", FIRST + timedelta(days=d), "Difficult" if n == 0 else "Easy", 0.0) for d, size in days.items() for n in range(size)]
    daily = daily_destinations(scored(spark, table))
    by_row = {row[DAY]: row["destination_base_difficulty"] for row in destination_baseline(daily).collect()}
    assert by_row == {FIRST: None, FIRST + timedelta(days=1): None, FIRST + timedelta(days=10): 2 / 7}
    by_day = {row[DAY]: row["destination_base_difficulty"] for row in destination_baseline(daily, calendar=True).collect()}
    assert by_day[FIRST + timedelta(days=10)] is None


def test_baseline_does_not_see_its_own_day(spark):
    table = [("MIA", FIRST + timedelta(days=d), "Difficult" if (d + n) % 3 == 0 else "Easy", 0.0) for d in range(9) for n in range(6)]
    last = FIRST + timedelta(days=8)
    changed = [(a, day, "Difficult" if day == last else label, s) for a, day, label, s in table]
    before, after = (
        with_destination_baseline(scored(spark, rows)).where(F.col(DAY) == last).agg(F.max("destination_base_difficulty")).first()[0]
        for rows in (table, changed)
    )
    assert before == after > 0


def test_baseline_join_of_heavy_destinations(spark):
    table = [("MIA", FIRST + timedelta(days=n % 3), "Difficult" if n % 2 else "Easy", 0.0) for n in range(90)] + [(None, FIRST, "Easy", 0.0)]
    plain = with_destination_baseline(scored(spark, table))
    split = with_destination_baseline(scored(spark, table), limit=5, small=0)
    assert sorted(map(str, plain.select(sorted(plain.columns)).collect())) == sorted(map(str, split.select(sorted(plain.columns)).collect()))
    assert plain.count() == 91


def many_numbers(spark, groups=250, flights=9):
    """Recurring flight numbers with a few flights each, one of them twice in the table."""
    table = [(n, f"f{n % groups}", FIRST + timedelta(days=n // groups // 2), float(n * 37 % 101), float(n % 7)) for n in range(groups * flights)]
    return spark.createDataFrame([*table, table[5]], SCHEMA)


def test_few_tasks_however_small_the_limit(spark):
    """Groups are cut far smaller than a task's share; the tables written on the way have few files."""
    known = len(STAGED)
    cut = with_volatility(many_numbers(spark), ties=["id"], limit=6)
    assert cut.count() == 250 * 9 + 1
    assert max(len(glob.glob(f"{path.removeprefix('file:')}/part-*")) for path in STAGED[known:]) <= 8


@pytest.mark.parametrize("limit", [3, 6, 40])
def test_chunks_over_several_ranges(spark, monkeypatch, limit):
    """Ranges sorted by different tasks, chunks across them and frames longer than a chunk give what one window gives."""
    monkeypatch.setattr(spread, "RANGE_ROWS", 100)
    df = many_numbers(spark, groups=30)
    whole, cut = (rounded(with_volatility(df, ties=["id"], limit=size), ["id", "load_factor_volatility", "ground_time_pressure_volatility"]) for size in (None, limit))
    # Groups below the limit stay whole.
    assert cut == whole
    hot = df.withColumn("flight_number", F.lit("hot"))
    whole, cut = (rounded(with_volatility(hot, ties=["id"], limit=size), ["id", "load_factor_volatility"]) for size in (None, limit))
    assert cut == whole
