import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from skyload.config import DAY, Settings, normalise_weights, usable_features
from skyload.operators.scoring import score_days, score_twice

GOLDEN = [("F1", 10, 5, 0), ("F2", 20, 5, 5), ("F3", 25, 10, 8), ("F4", 10, 10, 2), ("F5", 25, 5, 8)]
SCHEMA = f"name string, {DAY} date, a double, b double, c double"
WEIGHTS = {"a": 0.5, "b": 0.3, "c": 0.2}


def brute_force(table, weights, difficult=0.25, medium=0.75):
    """Rank, score and class per row name, straight from the definition."""
    shares, result = normalise_weights(weights), {}
    for day in {row[1] for row in table}:
        group = [row for row in table if row[1] == day]
        scores = {row[0]: 0.0 for row in group}
        for at, name in enumerate(weights):
            known = [row[2 + at] for row in group if row[2 + at] is not None]
            low, high = (min(known), max(known)) if known else (0, 0)
            for row in group:
                if high > low and row[2 + at] is not None:
                    scores[row[0]] += (row[2 + at] - low) / (high - low) * shares[name]
        scores = {name: math.floor(score * 1e9 + 0.5) / 1e9 for name, score in scores.items()}
        distinct = sorted(set(scores.values()), reverse=True)
        for name, score in scores.items():
            rank = distinct.index(score) + 1
            share = (rank - 1) / max(len(group) - 1, 1)
            label = "Difficult" if share < difficult else "Medium" if share < medium else "Easy"
            result[name] = (score, rank, label)
    return result


def found(df):
    return {row["name"]: (row["difficulty_score"], row["daily_rank"], row["difficulty_class"]) for row in df.collect()}


def random_days(seed, days=4, size=30):
    source = random.Random(seed)
    table = []
    for d in range(days):
        for n in range(size if d else 1):
            values = [source.choice([None, source.randint(0, 4), source.random()]) for _ in range(3)]
            table.append((f"{d}-{n}", date(2025, 8, 1 + d) if d != 3 else None, *[None if v is None else float(v) for v in values]))
    return table


@pytest.mark.parametrize("strategy", ["auto", "window", "spread"])
def test_published_example(spark, strategy):
    table = [(name, date(2025, 8, 1), *map(float, values)) for name, *values in GOLDEN]
    result = found(score_days(spark.createDataFrame(table, SCHEMA), WEIGHTS, strategy=strategy))
    assert result["F1"] == (0.0, 5, "Easy")
    assert result["F2"] == (0.458333333, 3, "Medium")
    assert result["F3"] == (1.0, 1, "Difficult")
    assert result["F4"] == (0.35, 4, "Easy")
    assert result["F5"] == (0.7, 2, "Medium")


def test_eight_distinct_scores(spark):
    table = [(str(n), date(2025, 8, 1), float(n), 0.0, 0.0) for n in range(1, 9)]
    result = found(score_days(spark.createDataFrame(table, SCHEMA), WEIGHTS))
    by_rank = {rank: label for _, rank, label in result.values()}
    assert [by_rank[rank] for rank in range(1, 9)] == ["Difficult"] * 2 + ["Medium"] * 4 + ["Easy"] * 2


@pytest.mark.parametrize("strategy", ["window", "spread"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force_in_any_row_order(spark, strategy, seed):
    """Gaps, ties, a one-flight day and a missing day; values stay on their own rows."""
    table = random_days(seed)
    expected = brute_force(table, WEIGHTS)
    random.Random(seed).shuffle(table)
    assert found(score_days(spark.createDataFrame(table, SCHEMA), WEIGHTS, strategy=strategy)) == expected


def test_days_do_not_influence_each_other(spark):
    table = random_days(5)
    whole = found(score_days(spark.createDataFrame(table, SCHEMA), WEIGHTS))
    second = [row for row in table if row[1] == date(2025, 8, 2)]
    alone = found(score_days(spark.createDataFrame(second, SCHEMA), WEIGHTS))
    assert all(whole[name] == alone[name] for name in alone)


def test_tied_day_split_over_tasks(spark):
    """A score shared by most flights of a day is joined in parts and gives the same ranks."""
    table = [(str(n), date(2025, 8, 1), float(max(n - 180, 0)), 0.0, 0.0) for n in range(200)]
    df = spark.createDataFrame(table, SCHEMA)
    assert found(score_days(df, WEIGHTS, strategy="spread", limit=10, small=0)) == brute_force(table, WEIGHTS)


def test_all_tied_and_single_flight_days_are_difficult(spark):
    table = [("x", date(2025, 8, 1), 3.0, 1.0, 1.0)] + [(str(n), date(2025, 8, 2), 7.0, 7.0, 7.0) for n in range(4)]
    assert set(found(score_days(spark.createDataFrame(table, SCHEMA), WEIGHTS)).values()) == {(0.0, 1, "Difficult")}


def test_weights(spark):
    assert normalise_weights({"a": 2, "b": 2}) == {"a": 0.5, "b": 0.5}
    assert normalise_weights({"a": 0.4, "b": 0.6}) == {"a": 0.4, "b": 0.6}
    table = [("p", date(2025, 8, 1), 0.0, 0.0, 0.0), ("q", date(2025, 8, 1), 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(table, SCHEMA)
    with_absent = {"a": 0.5, "absent": 0.5}
    assert found(score_days(df, with_absent, ["a"]))["q"][0] == 0.5
    assert found(score_days(df, with_absent, ["a"], present_only=True))["q"][0] == 1.0
    with pytest.raises(ValueError, match="absent"):
        score_days(df, with_absent)


def test_settings():
    settings = Settings.from_mapping(
        {"weights": {"a": 1.0}, "thresholds": {"difficult": 0.1}, "rolling": {"volatility_window": 3}, "late_booking_days": 2}
    )
    assert (settings.difficult, settings.medium, settings.volatility_window, settings.late_booking_days) == (0.1, 0.75, 3, 2)
    assert usable_features({"b": 1, "a": 1, "c": 1}, ["a", "b"]) == ["b", "a"]
    assert settings.extended_weights({"b": 2.0}) == {"a": 1.0, "b": 2.0}
    with pytest.raises(ValueError):
        Settings(difficult=0.8)


def test_second_pass_equals_scoring_everything_again(spark):
    """Reused day extremes give what a full second scoring gives, with flights that lack a destination or day."""
    source = random.Random(9)
    table = []
    for d in range(1, 12):
        for n in range(12):
            where = source.choice(["AAA", "BBB", "CCC", None])
            table.append((f"{d}-{n}", date(2025, 8, d) if d != 5 or n else None, source.random(), source.random(), 0.0, where, n))
    df = spark.createDataFrame(table, SCHEMA + ", scheduled_arrival_station_code string, flight_number int")
    weights = {"a": 0.5, "b": 0.3, "destination_base_difficulty": 0.4}
    twice = score_twice(df, weights, ["a", "b"])
    base = twice.select("name", "destination_base_difficulty")
    again = score_days(df.join(base, "name"), weights)
    assert found(twice) == found(again)
    assert twice.agg(F.max("destination_base_difficulty")).first()[0] > 0
    spread = score_twice(df, weights, ["a", "b"], strategy="spread", limit=3, small=0)
    assert found(spread) == found(twice)
