"""Writing results and reading scores back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from skyload.config import DAY, FULL_WEIGHTS
from skyload.sources.tables import CSV_STYLE, LAYOUTS, clean_headers, typed

# Columns of a scores table that hold numbers, next to the scaled features.
MEASURED = {
    *FULL_WEIGHTS,
    "basic_economy_pax",
    "booking_lead_days_median",
    "checked_bags",
    "total_transfer_bags",
    "dep_delay_minutes",
    "turn_buffer_ratio",
    "scheduled_block_minutes",
    "long_haul_indicator",
    "is_express",
    "bag_intensity",
    "ssr_per_pax",
    "pressure_index",
}


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    """Any result as Parquet, or as CSV with a header, quotes in fields doubled."""
    in_format(df.write.mode(mode), format).save(path)


def in_format(writer: DataFrameWriter, format: str) -> DataFrameWriter:
    writer = writer.format(format)
    return writer.options(header=True, quote='"', escape='"', timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]") if format == "csv" else writer


def write_scores(scored: DataFrame, path: str, day: str = DAY, per: str = "day", mode: str = "overwrite", format: str = "parquet") -> None:
    """Scores partitioned by day (or month), so that one day can be written again by itself.

    The rebalance hint gives each partition its own files: small days are put together in one task,
    and a day far larger than the others is split over several. Only the partitions present in the table
    are replaced.
    """
    unit = F.col(day).cast("date")
    label = unit.cast("string") if per == "day" else F.date_format(unit, "yyyy-MM")
    name = f"score_{per}"
    table = scored.withColumn(name, label).hint("rebalance", name)
    in_format(table.write.mode(mode), format).option("partitionOverwriteMode", "dynamic").partitionBy(name).save(path)


def score_kinds(columns: Sequence[str]) -> dict[str, str]:
    """Kinds of the columns of a scores table in text form, known by name, so no pass is spent on guessing."""
    kinds = {name: "double" for name in columns if name.endswith("_scaled") or name in MEASURED}
    return {**kinds, **LAYOUTS["flights"], "daily_rank": "int", "difficulty_score": "double"}


def read_scores(
    spark: SparkSession,
    path: str,
    day: str = DAY,
    source: str = "parquet",
    needed: Sequence[str] = ("difficulty_class",),
    days: Sequence[str] | None = None,
) -> DataFrame:
    """Scores from an earlier run; the day as a date, bad ones as null.

    With ``days``, dates as text, only the folders of these days (or of their months) are read.
    """
    if source == "csv":
        text = clean_headers(spark.read.options(**CSV_STYLE).csv(path, header=True, inferSchema=False))
        df = typed(text, score_kinds(text.columns))
    else:
        df = spark.read.format(source).load(path)
    missing = [name for name in needed if name not in df.columns]
    if missing:
        raise ValueError(f"scores lack columns {missing}")
    for name, size in (("score_day", 10), ("score_month", 7)):
        if days is not None and name in df.columns:
            df = df.where(F.col(name).cast("string").isin(sorted({text[:size] for text in days})))
    if day in df.columns:
        df = df.withColumn(day, F.col(day).try_cast("date"))
    return df if days is None else df.where(F.col(day).cast("string").isin(sorted(days)))


def write_weights(tuned: DataFrame, path: str, target: str) -> DataFrame:
    """Tuned weights as one JSON record; returns what was written.

    The table has one row per feature.
    """
    scores = {"cv_score": "train_corr", "held_out_score": "test_corr", "auc": "auc"}
    record = tuned.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", "weight")))).alias("weights"),
        *[F.max(column).alias(name) for name, column in scores.items() if column in tuned.columns],
    ).withColumn("target", F.lit(target))
    record.write.mode("overwrite").json(path)
    return record
