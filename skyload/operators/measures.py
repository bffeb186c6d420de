"""Exploratory measures: delay, ground time, load, correlation, regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyload.config import FLIGHT_KEY
from skyload.functions.columns import pearson
from skyload.operators.bags import bag_shares
from skyload.operators.passengers import passenger_totals
from skyload.operators.spread import spread_join
from skyload.operators.staging import stage
from skyload.operators.turn import with_delay, with_ground_bands


def flight_loads(flights: DataFrame, bookings: DataFrame, key: Sequence[str] = FLIGHT_KEY, limit: int | None = None) -> DataFrame:
    """Flights with delay, ground-time bands, passengers and load factor."""
    measured = with_ground_bands(with_delay(flights))
    totals = passenger_totals(bookings, key)
    loaded = spread_join(measured, totals, key, sizes=flights, by=list(key), limit=limit).fillna(0, subset=["total_pax"])
    seats = F.col("total_seats")
    return loaded.withColumn("load_factor", F.when(seats > 0, F.col("total_pax") / seats))


def with_request_counts(
    loads: DataFrame,
    requests: DataFrame,
    key: Sequence[str] = FLIGHT_KEY,
    sizes: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    counts = requests.select(*key, "ssr_count")
    return spread_join(loads, counts, key, sizes=sizes, by=list(key), limit=limit).fillna(0, subset=["ssr_count"])


def percent(condition: Column) -> Column:
    """Share of all rows in percent; unknown counts as no."""
    return F.count_if(condition) / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100.0


def metric_rows(wide: DataFrame) -> DataFrame:
    """One-row table of measures to (metric, value) rows."""
    pairs = [F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("value")) for name in wide.columns]
    return wide.select(F.explode(F.array(*pairs)).alias("pair")).select("pair.metric", "pair.value")


def flight_metrics(loads: DataFrame) -> DataFrame:
    """The names of the measures."""
    measures = [F.avg("dep_delay_minutes").alias("avg_departure_delay_min")]
    measures.append(percent(F.col("dep_delay_minutes") > 0).alias("pct_flights_late"))
    if "ground_time_delta" in loads.columns:
        measures.append(percent(F.col("at_or_below_min_turn") == 1).alias("pct_ground_time_at_or_below_min"))
        measures.append(percent(F.col("within_5_min_above_min") == 1).alias("pct_ground_time_within_5_min"))
        ground = pearson(F.col("ground_time_delta").cast("double"), F.col("load_factor"))
    else:
        measures.append(F.lit(None).cast("double").alias("pct_ground_time_at_or_below_min"))
        measures.append(F.lit(None).cast("double").alias("pct_ground_time_within_5_min"))
        ground = F.lit(None).cast("double")
    measures.append(pearson(F.col("dep_delay_minutes"), F.col("load_factor")).alias("corr_loadfactor_delay"))
    measures.append(ground.alias("corr_loadfactor_ground_delta"))
    return metric_rows(loads.agg(*measures))


def metric_table(loads: DataFrame, bags: DataFrame, key: Sequence[str] = FLIGHT_KEY) -> DataFrame:
    """The seven summary measures over all rows."""
    shares = bag_shares(bags, key).agg(F.avg("transfer_ratio").alias("avg_transfer_ratio"))
    return flight_metrics(loads).unionByName(metric_rows(shares))


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Correlation of each pair over its complete rows."""
    measures = [
        pearson(F.col(x).cast("double"), F.col(y).cast("double")).alias(f"{x}~{y}") for x, y in pairs
    ]
    return metric_rows(df.agg(*measures))


def request_groups(loads: DataFrame) -> DataFrame:
    """Mean delay of the flights with the most requests (top quarter) and of those without any.

    Works on flights per request count: a handful of rows, since counts are small integers and n
    distinct ones need n(n-1)/2 requests.
    """
    by_count = stage(
        loads.groupBy("ssr_count").agg(
            F.count(F.lit(1)).alias("flights"),
            F.count("dep_delay_minutes").alias("delays"),
            F.sum("dep_delay_minutes").alias("delay"),
        )
    )
    threshold = by_count.agg(F.percentile(F.col("ssr_count"), 0.75, F.col("flights"))).scalar()
    known = by_count.withColumn("threshold", threshold)

    def mean_where(condition: Column) -> Column:
        delays = F.sum(F.when(condition, F.col("delays")))
        return F.sum(F.when(condition, F.col("delay"))) / F.nullif(delays, F.lit(0))

    return known.agg(
        F.max("threshold").cast("double").alias("threshold"),
        mean_where(F.col("ssr_count") >= F.col("threshold")).alias("mean_delay_high"),
        mean_where(F.col("ssr_count") == 0).alias("mean_delay_low"),
    )


# A determinant below this share of the squared trace is rounding: the two inputs are collinear.
COLLINEAR = 1e-14


def delay_regression(loads: DataFrame) -> DataFrame:
    """Least squares of delay on requests and load, over complete rows within a day's delay.

    One pass gives means and covariances, which Spark merges as central moments, so values far from zero keep their
    digits. The 2 x 2 system they form is solved by the pseudo-inverse, which also answers
    when the two inputs are collinear or one does not vary: a symmetric matrix of rank one is divided by its squared trace.
    """
    x1, x2, y = F.col("ssr_count").cast("double"), F.col("load_factor"), F.col("dep_delay_minutes")
    rows = loads.select(x1.alias("a"), x2.alias("b"), y.alias("y")).dropna().where(F.abs("y") < 1440)
    pairs = ("aa", "ab", "bb", "ay", "by", "yy")
    found = rows.agg(
        F.count(F.lit(1)).alias("n_obs"),
        *[F.avg(name).alias(name) for name in ("a", "b", "y")],
        *[F.covar_pop(p, q).alias(p + q) for p, q in pairs],
    )
    aa, ab, bb, ay, by, yy = (F.col(pair) for pair in pairs)
    solved = found.withColumns({"det": aa * bb - ab * ab, "trace": aa + bb, "enough": F.col("n_obs") >= 10})
    full, some = F.col("det") > F.lit(COLLINEAR) * F.col("trace") * F.col("trace"), F.col("trace") > 0

    def slope(by_inverse: Column, by_rank_one: Column) -> Column:
        squared = F.col("trace") * F.col("trace")
        return F.when(F.col("enough"), F.when(full, by_inverse / F.col("det")).when(some, by_rank_one / squared).otherwise(0.0))

    solved = solved.withColumns(
        {
            "coef_ssr_count": slope(bb * ay - ab * by, aa * ay + ab * by),
            "coef_load_factor": slope(aa * by - ab * ay, ab * ay + bb * by),
        }
    )
    first, second = F.col("coef_ssr_count"), F.col("coef_load_factor")
    return solved.select(
        (F.col("y") - first * F.col("a") - second * F.col("b")).alias("intercept"),
        "coef_ssr_count",
        "coef_load_factor",
        F.when(yy > 0, (first * ay + second * by) / yy).alias("r2"),
        "n_obs",
        F.when(~F.col("enough"), "not enough data").alias("note"),
    )
