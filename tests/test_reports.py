import dataclasses
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import airline, rounded
from skyload.config import DAY, FULL_WEIGHTS, Settings
from skyload.operators import staging
from skyload.plans import reports
from skyload.sources import sinks
from skyload.sources.tables import read_inputs


@pytest.fixture(scope="module")
def result(spark):
    return reports.analyse(airline(spark), Settings(weights=FULL_WEIGHTS))


def test_scores(spark, result):
    assert result.scored.count() == result.master.count() == 96
    low, high, best = result.scored.agg(F.min("difficulty_score"), F.max("difficulty_score"), F.min("daily_rank")).first()
    assert 0 <= low <= high <= 1 and best == 1
    assert {row[0] for row in result.scored.select("difficulty_class").distinct().collect()} <= {"Difficult", "Medium", "Easy"}
    assert {f"{name}_scaled" for name in FULL_WEIGHTS} <= set(result.scored.columns)
    assert result.scored.agg(F.max("destination_base_difficulty")).first()[0] > 0


def test_measures_and_insights(result):
    assert result.summary.count() == 7
    assert result.regression.first()["n_obs"] == 96
    assert result.request_delay.count() == 1
    assert -1 <= result.load_score_correlation.first()["value"] <= 1
    assert result.feature_correlation.count() == 17 * 17
    assert result.destinations.count() == 4
    assert result.drivers.count() == 20
    assert 0 < result.recommendations.count() <= 12
    assert {row["implemented"] for row in result.coverage.collect()} == {True}


def test_chart_tables(spark, result):
    charts = reports.chart_tables(result, airline(spark))
    assert charts["delay_distribution"].agg(F.sum("rows")).first()[0] == 96
    assert charts["ssr_vs_delay"].count() == 96 and charts["top_destination_consistency"].count() == 4
    assert charts["ssr_delay_trend"].first()["slope"] is not None
    assert charts["class_distribution"].agg(F.sum("flights")).first()[0] == 96
    assert 0 < charts["driver_feature_lift"].count() <= 12 and charts["transfer_ratio_hist"].count() > 0


def test_written_results_and_report(spark, result, tmp_path):
    reports.write_analysis(result, str(tmp_path))
    destinations, drivers, texts = reports.report_on_scores(spark, str(tmp_path / "scores"))
    assert rounded(destinations) == rounded(result.destinations)
    assert rounded(texts) == rounded(result.recommendations)
    assert drivers.count() == 20
    sinks.write_scores(result.scored.where("false"), str(tmp_path / "empty"))
    with pytest.raises(ValueError):
        sinks.write_table(result.scored.where("false"), str(tmp_path / "none"))
        reports.report_on_scores(spark, str(tmp_path / "none"))


def test_scoring_job(spark, tmp_path):
    scored = reports.score_flights(airline(spark, days=3), path=str(tmp_path / "scores"), extra_weights={"slot_congestion_count": 0.1, "no_such": 0.1})
    assert "slot_congestion_count_scaled" in scored.columns
    assert sinks.read_scores(spark, str(tmp_path / "scores")).select(DAY).distinct().count() == 3


@pytest.mark.parametrize("target,method", [("delay", "gradient"), ("difficulty", "candidates")])
def test_tuning_job(result, tmp_path, target, method):
    tuned = reports.tune(result.scored, Settings(weights={"total_pax": 0.5, "ssr_count": 0.3, "load_factor": 0.2, "absent": 1.0}), target, method=method, path=str(tmp_path / "w"))
    assert tuned.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)
    record = json.loads("".join(file.read_text() for file in (tmp_path / "w").glob("*.json")))
    assert record["target"] == target and ("auc" in record) == (target == "difficulty")
    assert set(record["weights"]) == {"total_pax", "ssr_count", "load_factor"}
    with pytest.raises(ValueError):
        reports.tune(result.scored, Settings(weights={"absent": 1.0}))


MESSY = {"company_id": " company_id ", "flight_number": "flight_number ", "total_seats": " total_seats"}


def test_from_text_files_to_scores(spark, tmp_path):
    """The same scores from messy text files, with weather, as from typed tables."""
    inputs = airline(spark, days=4)
    seen = [("ORD", datetime(2025, 8, 1 + n % 4, 6 + n % 5, n % 60), n / 40) for n in range(40)]
    weather = spark.createDataFrame(seen, "station_code string, observation_time timestamp_ntz, weather_severity_index double")
    inputs = dataclasses.replace(inputs, weather=weather)
    paths = {}
    for field in dataclasses.fields(inputs):
        df = getattr(inputs, field.name)
        paths[field.name] = str(tmp_path / field.name)
        if DAY in df.columns and field.name == "bags":
            df = df.withColumn(DAY, F.date_format(DAY, "M/d/yyyy"))
        renamed = df.toDF(*[MESSY.get(name, name) for name in df.columns])
        writer = renamed.write.option("header", True).option("nullValue", "NA").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(paths[field.name])
    settings = Settings(weights=FULL_WEIGHTS)
    names = ["flight_number", DAY, "weather_severity_index", "difficulty_score", "daily_rank", "difficulty_class"]
    typed = reports.score_flights(inputs, settings)
    text = reports.score_flights(read_inputs(spark, paths), settings)
    assert rounded(text, names) == rounded(typed, names)
    assert typed.agg(F.max("weather_severity_index")).first()[0] > 0


def test_staged_tables_can_be_released(spark, monkeypatch):
    monkeypatch.setattr(staging, "STAGED", [])
    df = staging.stage(spark.range(3))
    assert df.count() == 3 and staging.release_staged(spark) == 1 and staging.release_staged(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()
