"""Mixing sources to target weights: weighted sampling without replacement by exponential keys, after whole epochs."""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyload.llm.common import WHITE, per_text, uniform
from skyload.operators.staging import stage

#: Weights of the sources in their order by code point, repeating.
WEIGHTS = (5, 2, 1)
#: A source is repeated three times at most.
MOST_EPOCHS = 3
#: Keys are cut into so many ranges per doubling of the key. Whatever the quality, exponential keys spread over many doublings and no
#: range holds more than a two-thousandth of the rows of one quality, so no task sorts a whole source; one task sums the ranges of a source.
RANGES = 512

NOT_LETTERS = bytes(c for c in range(128) if chr(c) not in string.ascii_letters)


def measure(text: bytes) -> tuple[int, float]:
    """(words, quality): the words between white space, and the squared share of letters among the other characters, at least 0.05."""
    body = len(text.translate(None, WHITE.encode()))
    letters = len(text.translate(None, NOT_LETTERS))
    return len(text.split()), max(0.05, (letters / body) ** 2) if body else 0.05


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, each at most ``most`` times its size.

    What a full source cannot take goes to the others by weight until none is above its limit. That is one water level:
    with the sources in order of limit / weight, the level is the largest of what remains per weight among those that stay
    below their limit. Sources are ordered by code point, null last. The table has one row per source, which is
    what the two windows without partition see.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(listed, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size").cast("double") * most)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.col("source_size").cast("double")).over(everything)
    full, spent = F.coalesce(F.sum("most").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (total - full) / (F.sum("weight").over(everything) - spent)
    leveled = ranked.withColumn("level", level)
    water = F.max(F.when(F.col("most") / F.col("weight") >= F.col("level"), F.col("level"))).over(everything)
    return leveled.withColumn("water", water).select(
        "source", "source_size", F.least("most", F.col("weight") * F.coalesce("water", F.lit(0.0))).alias("target")
    )


def sample_keys(seed: int, *identity: Column) -> Column:
    """-ln(u) / quality, an exponential key: smaller is drawn earlier."""
    return F.greatest(-F.log(uniform(*identity, seed=seed)) / F.col("quality"), F.lit(1e-300))


def mix_sources(
    docs: DataFrame,
    keep: list[str] | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    seed: int = 42,
) -> DataFrame:
    """The rows of ``docs`` with size, source_size, target, epochs and taken (words the mix takes, repeats counted).

    ``keep`` names the columns to carry (all if left out); results come in a struct ``mix`` beside a struct ``row``
    of these, so no names can clash. A source whose target holds n whole epochs takes every document n times; the rest
    of its target is filled by weighted sampling without replacement: documents in the order of exponential keys
    -ln(u) / quality, u from a hash of id and text, until the running sum of words reaches it. The document that crosses the
    border is taken if more than half of it lies below. Running sums come from sums per key range and windows inside a
    range, so a source of any size is spread over many tasks.

    Null texts have size 0, null sources form one source (the last), null ids are allowed. Documents without words are never
    taken. Rows that are equal in id and text share a key; which of them comes first does not matter.
    """
    sized = per_text(measure, "struct<size:long,quality:double>", pa.struct([("size", pa.int64()), ("quality", pa.float64())]))
    columns = docs.columns if keep is None else keep
    named = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in columns]).alias("row") if columns else F.lit(None).alias("row"),
        F.col(id_column).alias("doc_id"),
        F.col(source_column).alias("source"),
        F.xxhash64(text_column).alias("text_hash"),
        sized(text_column).alias("measured"),
    )
    key = sample_keys(seed, F.col("doc_id"), F.col("text_hash"))
    keyed = (
        named.select("row", "doc_id", "source", "text_hash", "measured.size", "measured.quality")
        .withColumn("key", key)
        .withColumn("range", F.floor(F.log2("key") * RANGES).cast("int"))
    )
    # Written once, so that sums and rows come from the very same numbers and the texts are split once.
    ranges = stage(keyed.groupBy("source", "range").agg(F.sum("size").alias("words")))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(
        F.col("source").alias("range_source"), F.col("range").alias("range_number"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"),
    ).join(targets, F.col("range_source").eqNullSafe(F.col("source"))).drop("source")
    same = F.col("source").eqNullSafe(F.col("range_source")) & (F.col("range") == F.col("range_number"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.join(starts, same).withColumn("until", F.col("start") + F.sum("size").over(inside))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    drawn = (F.col("until") - F.col("size") / 2 < rest) & (F.col("size") > 0)
    return (
        placed.withColumn("epochs", epochs)
        .withColumn("times", F.when(F.col("size") > 0, F.col("epochs") + F.when(drawn, 1).otherwise(0)).otherwise(0))
        .select(
            "row",
            F.struct("size", "source_size", "target", "epochs", "times", (F.col("times") * F.col("size")).alias("taken")).alias("mix"),
        )
    )


def draw_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with the columns of ``docs``: each row as often as it is taken."""
    mixed = mix_sources(docs, **options).where("mix.times > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("mix.times").cast("int")))).select("row.*")
