"""The jobs a user runs: score flights, analyse everything, report on stored scores, tune weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyload.config import ACTUAL_DEPARTURE, DEFAULT_WEIGHTS, DEPARTURE, DESTINATION, FLIGHT_KEY, Settings, usable_features
from skyload.operators.bags import bag_shares
from skyload.operators.charts import class_counts, histogram, scatter_points, trend_line
from skyload.operators.insights import destination_consistency, driver_lifts, mean_lifts, recommendations
from skyload.operators.measures import (
    correlations,
    delay_regression,
    flight_loads,
    metric_table,
    request_groups,
    with_request_counts,
)
from skyload.operators.scoring import BASELINE, score_days, score_twice
from skyload.operators.service import service_features
from skyload.operators.staging import stage
from skyload.operators.tuning import (
    blend,
    correlation_matrix,
    design_columns,
    rank_quality,
    tune_weights,
    with_fold,
    with_target,
)
from skyload.operators.turn import with_delay
from skyload.plans.features import build_extended_features, build_features
from skyload.sources.sinks import read_scores, write_scores, write_table, write_weights
from skyload.sources.tables import Inputs

# Which features stand for which area of the analysis, and whether all are needed.
COVERAGE = {
    "ground_time_constraints": (("ground_time_pressure", "turn_buffer_ratio"), True),
    "flight_specific_characteristics": (
        ("total_bags", "load_factor", "aircraft_size_category", "is_express"),
        False,
    ),
    "passenger_service_needs": (("ssr_count", "children", "stroller_users", "lap_children"), True),
    "additional_exploration": (
        ("bag_intensity", "ssr_per_pax", "pressure_index", "scheduled_block_minutes"),
        True,
    ),
}


@dataclass(frozen=True)
class Analysis:
    """Results of the full analysis; every field is a DataFrame that can still be refined."""

    master: DataFrame
    scored: DataFrame
    loads: DataFrame
    summary: DataFrame
    regression: DataFrame
    request_delay: DataFrame
    load_score_correlation: DataFrame
    feature_correlation: DataFrame
    destinations: DataFrame
    drivers: DataFrame
    recommendations: DataFrame
    coverage: DataFrame


def feature_coverage(scored: DataFrame) -> DataFrame:
    """Whether each area of the analysis has its features, and for how many flights they are all known."""
    have = set(scored.columns)
    counts, areas = [], []
    for area, (names, every) in COVERAGE.items():
        present = [name for name in names if name in have]
        implemented = len(present) == len(names) if every else bool(present)
        known = reduce(Column.__and__, [F.col(name).isNotNull() for name in present], F.lit(implemented))
        counts.append(F.count_if(known).alias(area))
        areas.append(
            F.struct(F.lit(area).alias("category"), F.lit(implemented).alias("implemented"), F.col(area).alias("known_flights"))
        )
    return scored.agg(*counts).select(F.explode(F.array(*areas)).alias("area")).select("area.*")


def score_flights(
    inputs: Inputs,
    settings: Settings | None = None,
    extra_weights: Mapping[str, float] | None = None,
    path: str | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Features and one scoring pass; written to ``path`` if given."""
    settings = settings or Settings()
    master = stage(build_features(inputs, settings, ties=ties))
    weights = settings.extended_weights(extra_weights)
    features = usable_features(weights, master.columns)
    scored = score_days(master, weights, features, settings.difficult, settings.medium)
    if path:
        write_scores(scored, path)
    return scored


def analyse(
    inputs: Inputs, settings: Settings | None = None, top_n: int = 10, ties: Sequence[str] = ()
) -> Analysis:
    """Everything: features, measures, two-pass scores, destinations, drivers, advice.

    The feature table and the scores are written once to the shared folder; all results read those.
    """
    settings = settings or Settings()
    key = list(settings.key)
    master = stage(build_extended_features(inputs, settings, ties=ties))
    weights = dict(settings.weights)
    scored = stage(
        score_twice(
            master,
            weights,
            usable_features(weights, [*master.columns, BASELINE]),
            settings.difficult,
            settings.medium,
            settings.destination_window,
            settings.destination_min_flights,
        )
    )
    loads = stage(flight_loads(inputs.flights, inputs.bookings, key))
    requests = service_features(
        inputs.bookings, inputs.remarks, key, settings.mobility_keywords, settings.special_keywords, settings.ssr_mode
    )
    requested = stage(with_request_counts(loads, requests, key, sizes=inputs.flights))
    compared = [name for name in DEFAULT_WEIGHTS if f"{name}_scaled" in scored.columns]
    destinations = stage(destination_consistency(scored, top_n))
    drivers = stage(driver_lifts(scored, destinations))
    return Analysis(
        master=master,
        scored=scored,
        loads=requested,
        summary=metric_table(loads, inputs.bags, key),
        regression=delay_regression(requested),
        request_delay=request_groups(requested),
        load_score_correlation=correlations(scored, [("difficulty_score", "load_factor")]),
        feature_correlation=correlation_matrix(scored, {name: f"{name}_scaled" for name in compared}),
        destinations=destinations,
        drivers=drivers,
        recommendations=recommendations(drivers),
        coverage=feature_coverage(scored),
    )


def chart_tables(result: Analysis, inputs: Inputs, key: Sequence[str] = FLIGHT_KEY) -> dict[str, DataFrame]:
    """The data behind each chart of the analysis."""
    mixed = F.shiftrightunsigned(F.xxhash64(*key), 32)
    return {
        "delay_distribution": histogram(result.loads, "dep_delay_minutes", 50),
        "ground_vs_delay": scatter_points(result.loads, ["ground_time_delta", "dep_delay_minutes"], mixed, key),
        "transfer_ratio_hist": histogram(bag_shares(inputs.bags, key), "transfer_ratio", 40),
        "ssr_vs_delay": scatter_points(result.loads, ["ssr_count", "dep_delay_minutes"], mixed, key),
        "ssr_delay_trend": trend_line(result.loads, "ssr_count", "dep_delay_minutes"),
        "top_destination_consistency": result.destinations.select(DESTINATION, "consistency_index"),
        "driver_feature_lift": mean_lifts(result.drivers, 12),
        "class_distribution": class_counts(result.scored),
    }


def write_analysis(result: Analysis, folder: str, format: str = "parquet") -> None:
    """Scores by day, and the result tables, below one folder, all in one format."""
    write_scores(result.scored, f"{folder}/scores", format=format)
    for name in ("feature_correlation", "destinations", "drivers", "summary"):
        write_table(getattr(result, name), f"{folder}/{name}", format)


def report_on_scores(
    spark: SparkSession, path: str, top_n: int = 10, source: str = "parquet", days: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Destinations, drivers and advice from stored scores, of all days or those named."""
    scored = read_scores(spark, path, source=source, needed=("difficulty_class", DESTINATION), days=days)
    if scored.isEmpty():
        raise ValueError("the scores table is empty")
    destinations = stage(destination_consistency(scored, top_n))
    drivers = stage(driver_lifts(scored, destinations))
    return destinations, drivers, recommendations(drivers)


def tune(
    scored: DataFrame,
    settings: Settings | None = None,
    target: str = "delay",
    k: int = 5,
    method: str = "gradient",
    path: str | None = None,
    fold: Column | None = None,
) -> DataFrame:
    """Weights tuned on the scores by cross-validation; written as JSON to ``path`` if given.

    The fold of a row is a hash of its key, or the number ``fold``.
    The search maximises correlation for either target. For the 0/1 target the rank quality (area under
    the ROC curve) of the final weights is reported too.
    """
    settings = settings or Settings()
    features = usable_features(settings.weights, scored.columns)
    if not features:
        raise ValueError("the scores hold none of the weighted features")
    known = {DEPARTURE, ACTUAL_DEPARTURE} <= set(scored.columns)
    table, binary = with_target(with_delay(scored) if known else scored, target)
    columns = design_columns(table, features)
    design = with_fold(columns, list(settings.key), k) if fold is None else columns.withColumn("fold", fold.cast("int"))
    tuned = tune_weights(design, features, settings.weights, method)
    if binary:
        tuned = stage(tuned)
        tuned = tuned.withColumn("auc", rank_quality(blend(design, tuned, features)).select("auc").scalar())
    if path:
        write_weights(tuned, path, "difficulty" if binary else "delay")
    return tuned


