"""Daily scaling, weighted score, rank within the day, class."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyload.config import DAY, normalise_weights
from skyload.functions.columns import day_number
from skyload.functions.parsing import finite
from skyload.operators.history import daily_destinations, destination_baseline, with_baseline_values
from skyload.operators.spread import lookup_join, prior_totals
from skyload.operators.staging import fit_generated_code, stage

# A day with more flights than this is ranked by counting, not in one window partition.
DAY_ROWS = 500_000

# Scores are compared at nine digits, so sums that differ only by rounding tie.
POINTS = 1_000_000_000

BASELINE = "destination_base_difficulty"


def check_features(df: DataFrame, features: Sequence[str]) -> None:
    missing = [name for name in features if name not in df.columns]
    if missing:
        raise ValueError(f"features missing from the table: {missing}")


def day_ranges(master: DataFrame, features: Sequence[str], day: str = DAY) -> DataFrame:
    """Per day: flights, and the smallest and largest value of each feature. One row per calendar day."""
    check_features(master, features)
    bounds = []
    for name in features:
        value = finite(F.col(name).cast("double"))
        bounds += [F.min(value).alias(f"_min_{name}"), F.max(value).alias(f"_max_{name}")]
    return master.groupBy(day_number(F.col(day)).alias("_day")).agg(F.count(F.lit(1)).alias("_flights"), *bounds)


def scaled(name: str) -> Column:
    """Position of the value between its day's extremes; 0 when the feature does not vary, is missing or is no finite number."""
    return F.coalesce((finite(F.col(name).cast("double")) - F.col(f"_min_{name}")) / F.col(f"_span_{name}"), F.lit(0.0))


def with_day_scaling(master: DataFrame, ranges: DataFrame, features: Sequence[str], day: str = DAY) -> DataFrame:
    """Add ``<feature>_scaled``; keeps ``_day`` and ``_flights`` for the ranking.

    The width of each range, null where it is 0, is worked out once per day before the join.
    """
    fit_generated_code(master.sparkSession)
    bounds = []
    for name in features:
        low, high = F.col(f"_min_{name}"), F.col(f"_max_{name}")
        bounds += [low, F.nullif(high - low, F.lit(0.0)).alias(f"_span_{name}")]
    spans = ranges.select("_day", "_flights", *bounds)
    joined = lookup_join(master.withColumn("_day", day_number(F.col(day))), spans, ["_day"], "inner")
    used = [f"_{end}_{name}" for name in features for end in ("min", "span")]
    return joined.withColumns({f"{name}_scaled": scaled(name) for name in features}).drop(*used)


def weighted_points(
    weights: Mapping[str, float], features: Sequence[str], present_only: bool = False
) -> Column:
    """Weighted sum of the scaled features in their given order, in billionths."""
    if present_only:
        weights = {name: weights[name] for name in features}
    shares = normalise_weights(weights)
    total = F.lit(0.0)
    for name in features:
        total = total + F.col(f"{name}_scaled") * F.lit(shares[name])
    return F.round(total * F.lit(float(POINTS))).cast("bigint")


def with_daily_rank(
    scored: DataFrame, strategy: str, by: Sequence[str], limit: int | None = None, small: int | None = None
) -> DataFrame:
    """Dense rank of ``_points`` within ``_day``, best first.

    ``window`` sorts each day in one partition. ``spread`` counts distinct scores per day in
    bounded buckets and joins the rank back, splitting scores that very many flights share.
    """
    if strategy == "window":
        order = Window.partitionBy("_day").orderBy(F.col("_points").desc())
        return scored.withColumn("daily_rank", F.dense_rank().over(order))
    if strategy != "spread":
        raise ValueError(f"unknown ranking strategy: {strategy}")
    counted = prior_totals(scored, ["_day"], "_points", {"_tied": F.count(F.lit(1))}, descending=True)
    rank = (F.col("keys_before") + 1).cast("int").alias("daily_rank")
    ranks = stage(counted.select("_day", "_points", rank, "_tied"))
    return lookup_join(scored, ranks, ["_day", "_points"], rows="_tied", by=by, limit=limit, small=small)


def day_class(difficult: float = 0.25, medium: float = 0.75) -> Column:
    """Class by the rank's share of the day: (rank - 1) / (flights - 1), strict limits."""
    share = (F.col("daily_rank") - 1) / F.greatest(F.col("_flights") - 1, F.lit(1))
    return F.when(share < difficult, "Difficult").when(share < medium, "Medium").otherwise("Easy")


def chosen_strategy(ranges: DataFrame, strategy: str) -> str:
    """For ``auto``: ``window`` if the busiest day fits one window partition, else ``spread``."""
    if strategy != "auto":
        return strategy
    busiest = ranges.agg(F.max("_flights")).first()[0] or 0
    return "window" if busiest <= DAY_ROWS else "spread"


@dataclass(frozen=True)
class Ranking:
    """How scaled rows become scores, ranks and classes."""

    weights: Mapping[str, float]
    difficult: float = 0.25
    medium: float = 0.75
    strategy: str = "window"
    present_only: bool = False
    limit: int | None = None
    small: int | None = None

    def apply(self, rows: DataFrame, features: Sequence[str]) -> DataFrame:
        pointed = rows.withColumn("_points", weighted_points(self.weights, features, self.present_only))
        by = [f"{name}_scaled" for name in features[:4]]
        ranked = with_daily_rank(pointed, self.strategy, by, self.limit, self.small)
        score = F.col("_points") / F.lit(float(POINTS))
        classified = ranked.withColumns(
            {"difficulty_score": score, "difficulty_class": day_class(self.difficult, self.medium)}
        )
        return classified.drop("_points", "_day", "_flights")


def score_days(
    master: DataFrame,
    weights: Mapping[str, float],
    features: Sequence[str] | None = None,
    difficult: float = 0.25,
    medium: float = 0.75,
    day: str = DAY,
    strategy: str = "auto",
    present_only: bool = False,
    limit: int | None = None,
    small: int | None = None,
) -> DataFrame:
    """Add scaled features, score, daily rank and class to each flight.

    The table is read for the day extremes, then for the score; stage an expensive one first.
    The extremes are one short row per calendar day, written, counted and then broadcast. Weights are normalised over all keys, those of absent features too,
    unless ``present_only``. ``auto`` ranks by window only if the busiest day is small enough.
    """
    features = list(weights if features is None else features)
    ranges = stage(day_ranges(master, features, day))
    rows = with_day_scaling(master, ranges, features, day)
    ranking = Ranking(weights, difficult, medium, chosen_strategy(ranges, strategy), present_only, limit, small)
    return ranking.apply(rows, features)


def baseline_ranges(base: DataFrame, ranges: DataFrame, day: str = DAY) -> DataFrame:
    """Day extremes of the baseline from its table per destination and day, without reading flights again.

    Flights that have no destination are not in that table; their baseline is 0.
    """
    value = F.coalesce(BASELINE, F.lit(0.0))
    listed = base.groupBy(day_number(F.col(day)).alias("_day")).agg(
        F.sum("flights").alias("_listed"), F.min(value).alias("_low"), F.max(value).alias("_high")
    )
    all_listed = F.col("_listed") == F.col("_flights")
    zero = F.when(F.coalesce(all_listed, F.lit(False)), None).otherwise(0.0)
    return ranges.select("_day", "_flights").join(listed, "_day", "left").select(
        "_day",
        "_flights",
        F.least("_low", zero).alias(f"_min_{BASELINE}"),
        F.greatest("_high", zero).alias(f"_max_{BASELINE}"),
    )


def score_twice(
    master: DataFrame,
    weights: Mapping[str, float],
    features: Sequence[str],
    difficult: float = 0.25,
    medium: float = 0.75,
    window: int = 7,
    min_flights: int = 5,
    calendar: bool = False,
    day: str = DAY,
    strategy: str = "auto",
    limit: int | None = None,
    small: int | None = None,
) -> DataFrame:
    """Score, derive each destination's baseline from the classes, and score again with it.

    The first pass is read for its classes per destination and day only. The second scales only the
    baseline: no other feature has changed, so its day extremes are used again.
    """
    first = [name for name in features if name != BASELINE]
    plain = master.drop(BASELINE)
    ranges = stage(day_ranges(plain, first, day))
    ranking = Ranking(weights, difficult, medium, chosen_strategy(ranges, strategy), False, limit, small)
    rows = with_day_scaling(plain, ranges, first, day)
    if BASELINE not in weights:
        return ranking.apply(rows, first)
    daily = daily_destinations(ranking.apply(rows, first), day)
    base = stage(destination_baseline(daily, window, min_flights, calendar, day))
    based = with_baseline_values(rows, base, day, limit=limit, small=small)
    second = with_day_scaling(based.drop("_day", "_flights"), stage(baseline_ranges(base, ranges, day)), [BASELINE], day)
    return ranking.apply(second, [*first, BASELINE])
