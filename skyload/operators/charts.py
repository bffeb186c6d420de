"""Tables behind the charts: histograms, trend line, scatter points, class counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyload.operators.spread import prior_totals


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Rows per equal-width bin between the smallest and largest value; the last bin is closed."""
    value = F.col(column).cast("double")
    known = df.select(value.alias("_value")).where(value.isNotNull())
    ends = known.agg(F.struct(F.min("_value").alias("low"), F.max("_value").alias("high"))).scalar()
    placed = known.withColumn("_ends", ends).select("_value", F.col("_ends.low").alias("low"), F.col("_ends.high").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    place = F.when(width > 0, F.floor((F.col("_value") - F.col("low")) / F.nullif(width, F.lit(0.0)))).otherwise(F.lit(0).cast("bigint"))
    number = F.least(place, F.lit(bins - 1)).cast("bigint")
    counted = placed.groupBy(number.alias("bin"), "low", width.alias("width")).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select("bin", (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"), "rows")


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Straight line through all points; null when x does not vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    u, v = F.col(x).cast("double"), F.col(y).cast("double")
    sums = df.where(both).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(u).alias("low"),
        F.max(u).alias("high"),
        F.avg(u).alias("mean_x"),
        F.avg(v).alias("mean_y"),
        F.covar_pop(u, v).alias("cov"),
        F.var_pop(u).alias("var"),
    )
    slope = F.when(F.col("high") > F.col("low"), F.col("cov") / F.nullif(F.col("var"), F.lit(0.0)))
    return sums.select(
        slope.alias("slope"), (F.col("mean_y") - slope * F.col("mean_x")).alias("intercept"), F.col("n").alias("points")
    )


# Bits of a mixing function, and those that the histogram of it counts.
MIXED_BITS, COUNTED_BITS = 32, 20


def scatter_points(df: DataFrame, columns: Sequence[str], mixed: Column, ties: Sequence[str], points: int = 3000) -> DataFrame:
    """A repeatable sample: the rows first in the order of ``mixed``, a mixing function of their key below 2^32, and of ``ties``.

    A histogram of the first 20 bits of ``mixed`` tells the value up to which there are enough rows; only the rows
    up to it, about ``points`` and a millionth of all, are sorted.
    """
    place = F.shiftright(mixed.cast("bigint"), MIXED_BITS - COUNTED_BITS)
    counted = prior_totals(df.select(place.alias("_place")), [], "_place", {"_rows": F.count(F.lit(1))}, keep=False)
    cut = counted.where(F.col("_rows_before") < points).agg(F.max("_place")).scalar()
    return df.where(place <= cut).orderBy(mixed, *ties).limit(points).select(*columns)


def class_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("difficulty_class").agg(F.count(F.lit(1)).alias("flights"))
