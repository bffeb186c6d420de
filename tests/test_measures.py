import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import airline
from skyload.operators import charts
from skyload.operators.measures import correlations, delay_regression, flight_loads, metric_table, request_groups, with_request_counts
from skyload.operators.service import service_features
from skyload.operators.turn import with_delay


def table(spark, rows):
    return spark.createDataFrame(rows, "ssr_count bigint, load_factor double, dep_delay_minutes double")


def sample(size, seed=4):
    source = np.random.default_rng(seed)
    ssr, load = source.integers(0, 6, size), source.random(size)
    delay = 3.0 + 2.0 * ssr - 7.0 * load + source.normal(size=size)
    return [(int(a), float(b), float(c)) for a, b, c in zip(ssr, load, delay)]


def test_correlation_of_complete_pairs(spark):
    rows = [(1, 0.1, 5.0), (2, None, 90.0), (3, 0.4, 7.0), (9, 0.9, None), (4, 0.2, 1.0), (4, 0.7, 3.0)]
    complete = np.array([(b, c) for _, b, c in rows if b is not None and c is not None]).T
    found = correlations(table(spark, rows), [("load_factor", "dep_delay_minutes")]).first()["value"]
    assert found == pytest.approx(np.corrcoef(complete)[0, 1], abs=1e-12)


def test_correlation_without_variation_is_null(spark):
    rows = [(1, 0.5, 1.0), (2, 0.5, 2.0), (3, 0.5, 4.0)]
    assert correlations(table(spark, rows), [("load_factor", "dep_delay_minutes")]).first()["value"] is None


def test_regression(spark):
    rows = sample(200)
    with_noise = rows + [(1, None, 4.0), (1, 0.5, None), (5, 0.1, 5000.0)]
    design = np.array([(1, a, b) for a, b, _ in rows])
    target = np.array([c for *_, c in rows])
    beta, *_ = np.linalg.lstsq(design, target, rcond=None)
    r2 = 1 - ((target - design @ beta) ** 2).sum() / ((target - target.mean()) ** 2).sum()
    found = delay_regression(table(spark, with_noise)).first()
    assert [found["intercept"], found["coef_ssr_count"], found["coef_load_factor"]] == pytest.approx(beta, abs=1e-8)
    assert (found["n_obs"], found["note"]) == (200, None)
    assert found["r2"] == pytest.approx(r2, abs=1e-9)


def test_regression_on_collinear_inputs(spark):
    """Load is a tenth of the requests: the answer of least norm."""
    rows = [(n % 5, (n % 5) / 10, 2.0 * (n % 5) + n % 3) for n in range(30)]
    design = np.array([(1, a, b) for a, b, _ in rows])
    beta = np.linalg.pinv(design) @ np.array([c for *_, c in rows])
    found = delay_regression(table(spark, rows)).first()
    assert [found["intercept"], found["coef_ssr_count"], found["coef_load_factor"]] == pytest.approx(beta, abs=1e-6)


def test_regression_needs_ten_rows(spark):
    found = delay_regression(table(spark, sample(9))).first()
    assert (found["note"], found["n_obs"], found["intercept"]) == ("not enough data", 9, None)


def test_request_groups(spark):
    rows = sample(101) + [(0, 0.5, None)]
    counts = [a for a, *_ in rows]
    threshold = float(np.quantile(counts, 0.75))
    found = request_groups(table(spark, rows)).first()
    assert found["threshold"] == threshold
    assert found["mean_delay_high"] == pytest.approx(np.mean([c for a, _, c in rows if a >= threshold and c is not None]))
    assert found["mean_delay_low"] == pytest.approx(np.mean([c for a, _, c in rows if a == 0 and c is not None]))
    none_without = request_groups(table(spark, [(2, 0.1, 5.0), (3, 0.2, 6.0)])).first()
    assert none_without["mean_delay_low"] is None


def test_summary_measures(spark):
    inputs = airline(spark)
    loads = flight_loads(inputs.flights, inputs.bookings)
    found = {row["metric"]: row["value"] for row in metric_table(loads, inputs.bags).collect()}
    assert len(found) == 7
    delays = [row[0] for row in with_delay(inputs.flights).select("dep_delay_minutes").collect()]
    assert found["avg_departure_delay_min"] == pytest.approx(np.mean(delays))
    assert found["pct_flights_late"] == pytest.approx(100 * np.mean([d > 0 for d in delays]))
    bare = metric_table(flight_loads(inputs.flights.drop("minimum_turn_minutes"), inputs.bookings), inputs.bags)
    assert {row["metric"]: row["value"] for row in bare.collect()}["pct_ground_time_within_5_min"] is None
    requests = service_features(inputs.bookings, inputs.remarks)
    assert with_request_counts(loads, requests).where("ssr_count IS NULL").count() == 0


def test_histogram_and_trend(spark):
    rows = sample(300)
    values = [c for *_, c in rows]
    counts, edges = np.histogram(values, bins=50)
    found = {row["bin"]: row for row in charts.histogram(table(spark, rows), "dep_delay_minutes", 50).collect()}
    assert [found[n]["rows"] if n in found else 0 for n in range(50)] == counts.tolist()
    assert all(row["bin_start"] == pytest.approx(edges[n]) for n, row in found.items())
    same = charts.histogram(table(spark, [(1, 0.5, 2.0)] * 4), "load_factor", 10).collect()
    assert [(row["bin"], row["rows"]) for row in same] == [(0, 4)]
    assert charts.histogram(table(spark, [(1, None, 2.0)]), "load_factor", 10).count() == 0
    slope, intercept = np.polyfit([a for a, *_ in rows], values, 1)
    line = charts.trend_line(table(spark, rows), "ssr_count", "dep_delay_minutes").first()
    assert (line["slope"], line["intercept"]) == (pytest.approx(slope), pytest.approx(intercept))
    flat = charts.trend_line(table(spark, [(1, 0.5, 2.0)] * 4), "ssr_count", "dep_delay_minutes").first()
    assert flat["slope"] is None


def test_scatter_points_repeat(spark):
    df = spark.range(100).withColumn("y", F.col("id") * 2)
    mixed = F.col("id") * 2654435761 % 4294967296
    pick = lambda parts: {tuple(row) for row in charts.scatter_points(df.repartition(parts), ["id", "y"], mixed, ["id"], 10).collect()}
    first = sorted(range(100), key=lambda n: n * 2654435761 % 4294967296)[:10]
    assert pick(2) == pick(7) == {(n, 2 * n) for n in first}
    same = charts.scatter_points(df, ["id"], F.col("id") * 0 + 5, ["id"], 7).collect()
    assert [row["id"] for row in same] == list(range(7)) and charts.scatter_points(df.where("id < 0"), ["id"], mixed, ["id"], 7).count() == 0
