"""Joins, running totals and trailing windows that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from skyload.operators.staging import remembered, stage

# A key with about this many rows or more is split over several tasks.
HOT_ROWS = 2_000_000

# Rows that one task takes through the joins, aggregates and windows on a key.
TASK_ROWS = 300_000

# Rows that one task sorts when rows are numbered in order.
RANGE_ROWS = 200_000

# Rows of a key at the limit that the search for such keys expects to see.
SEEN_ROWS = 1_000

# Parts for left rows that lack a key.
MISSING_PARTS = 10_000

# Width of the first-level bucket of an integer key in running totals: a bucket holds at most
# this many distinct keys, and a key range of a billion has at most 30,518 buckets.
BUCKET_WIDTH = 32_768

# Widths for keys that use all 64 bits: buckets of a bucket's keys, of a bucket's buckets, and of the whole, are at most about two million.
WIDE_BUCKETS = (1 << 42, 1 << 21)


def in_parts(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Rows shuffled by the keys into tasks of about ``TASK_ROWS``; ``rows`` is about how many there are.

    Adaptive execution merges partitions by their compressed bytes, but joins, aggregates and windows that follow each other on one
    partitioning each hold the rows unpacked, some thirty times those bytes together. A number of partitions that is asked for is not
    merged. A table with few rows for the cores at hand is left to adaptive execution.
    """
    spark = df.sparkSession
    parts = -(-rows // TASK_ROWS)
    if parts <= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def hot_keys(
    df: DataFrame, keys: Sequence[str], limit: int | None = None, rows: Column | None = None
) -> DataFrame | None:
    """Keys with more than ``limit`` rows and the number of parts to split each into; None if there are none.

    Only the balance of later joins depends on the answer, never their result, so a large table is
    searched by counting a random share of its key columns: it costs a narrow scan and hardly any
    shuffle. With ``rows``, a column of counts, the answer is exact. There are at most
    about (all rows / limit) such keys, so the table is small beside the data; it is written once, so that
    both sides of a join use the same one, and remembered for later joins of the same table on the same keys.
    """
    limit = limit or HOT_ROWS
    return remembered("keys", df, [*keys, limit, rows], lambda: counted_hot_keys(df, keys, limit, rows))


def counted_hot_keys(df: DataFrame, keys: Sequence[str], limit: int, rows: Column | None) -> DataFrame | None:
    if rows is None:
        share = min(1.0, SEEN_ROWS / limit)
        seen = df.select(*keys) if share == 1.0 else df.select(*keys).sample(fraction=share, seed=17)
        counted = seen.groupBy(*keys).agg((F.count(F.lit(1)) / F.lit(share)).alias("_rows"))
        least = limit if share == 1.0 else limit / 2
    else:
        counted, least = df.groupBy(*keys).agg(F.sum(rows).alias("_rows")), limit
    heavy = counted.where(F.col("_rows") > least)
    if heavy.isEmpty():
        return None
    return stage(heavy.select(*keys, F.ceil(F.col("_rows") / F.lit(limit)).cast("int").alias("_parts")))


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], hot: DataFrame, how: str, by: Sequence[str]
) -> DataFrame:
    """Join with the rows of the hot keys cut into parts.

    A left row's part is a hash of the columns ``by`` and of its input partition, so exact copies are
    split too and a repeated task repeats its choice. The right rows of hot keys are copied
    once per part. The hot table has at most (all rows / limit) rows; it is a written table, so Spark knows its bytes
    and sends it to every executor only below its broadcast limit.
    """
    keys = list(keys)
    mixed = F.xxhash64(*by, F.spark_partition_id())
    part = F.when(F.col("_parts") > 1, F.pmod(mixed, F.col("_parts"))).otherwise(0)
    # Rows with a missing key match nothing, so they may go anywhere.
    unmatched = reduce(Column.__or__, [F.col(name).isNull() for name in keys])
    part = F.when(unmatched, F.pmod(mixed, F.lit(MISSING_PARTS))).otherwise(part).cast("int")
    parted = left.join(hot, keys, "left").withColumn("_part", part)
    all_parts = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    copied = right.join(hot, keys, "left").withColumn("_part", F.explode(all_parts)).drop("_parts")
    return parted.drop("_parts").join(copied, [*keys, "_part"], how).drop("_part")


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    sizes: DataFrame | None = None,
    rows: Column | None = None,
    by: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Join a large table to one with few rows per key, splitting the keys heavy on the left.

    ``sizes`` may name a cheaper table to search for heavy keys, or one with a count column ``rows``.
    Without heavy keys this is a plain join.
    """
    hot = hot_keys(left if sizes is None else sizes, keys, limit, rows)
    if hot is None:
        return left.join(right, list(keys), how)
    return salted_join(left, right, keys, hot, how, by or left.columns)


def lookup_join(
    left: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    sizes: DataFrame | None = None,
    rows: str | None = None,
    by: Sequence[str] | None = None,
    limit: int | None = None,
    small: int | None = None,
) -> DataFrame:
    """Join a written table with one row per key.

    Spark knows the bytes of a written table and sends it to every executor below its broadcast limit. Beyond it, this is
    a shuffle join of two tables, whose heavy keys adaptive execution splits. With ``small`` set, tables of more rows than that are
    joined by :func:`spread_join`, which needs no adaptive execution; ``rows`` then names the table's own column of
    matching left rows, if it has one.
    """
    values = table if rows is None else table.drop(rows)
    if small is None or table.count() <= small:
        return left.join(values, list(keys), how)
    if rows is not None:
        return spread_join(left, values, keys, how, table, F.col(rows), by, limit)
    return spread_join(left, values, keys, how, sizes, None, by, limit)


def attach_all(
    left: DataFrame,
    rights: Sequence[DataFrame],
    keys: Sequence[str],
    sizes: DataFrame | None = None,
    by: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Left join several tables that have one row per key and are grouped by it.

    Without heavy keys the joins follow each other on the partitioning of the grouped tables, so only the
    left table moves. Else the tables are put together first and joined once, in parts.
    """
    keys = list(keys)
    hot = hot_keys(left if sizes is None else sizes, keys, limit)
    if hot is None:
        for right in rights:
            left = left.join(right, keys, "left")
        return left
    together = rights[0]
    for right in rights[1:]:
        together = together.join(right, keys, "full")
    return salted_join(left, together, keys, hot, "left", by or left.columns)


def prior_totals(
    df: DataFrame,
    groups: Sequence[str],
    key: str,
    totals: dict[str, Column],
    descending: bool = False,
    widths: Sequence[int] = (BUCKET_WIDTH,),
    keep: bool = True,
) -> DataFrame:
    """Per group and distinct integer key: totals, and the totals of all keys that come before it.

    ``totals`` maps names to aggregates (sums or counts). The result has, for each name, the column
    itself and ``<name>_before``, and ``keys_before``, the number of distinct keys ahead. Groups of any
    size are fine: keys lie in buckets of the last of ``widths``, these in buckets of the width before, and so on, and a window sees
    at most the keys or buckets of one bucket, or the widest buckets of one group. The totals are written
    once, as they are read for the buckets and for the keys in them; without ``keep`` they are worked out where they are needed.
    """
    groups = list(groups)
    cells = df.groupBy(*groups, key).agg(*[value.alias(name) for name, value in totals.items()])
    cells = cells.withColumn("_keys", F.lit(1).cast("bigint"))
    if keep:
        cells = stage(cells)
    # Widths are powers of two; a shift rounds down and is exact for all 64 bits.
    places = {f"_bucket{at}": F.shiftright(F.col(key).cast("bigint"), width.bit_length() - 1) for at, width in enumerate(widths)}
    cells = cells.withColumns(places)
    names = [*totals, "_keys"]

    def ahead(name: str, partition: Sequence[str], order: str) -> Column:
        by = F.col(order).desc() if descending else F.col(order).asc()
        frame = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(name).over(frame), F.lit(0))

    buckets = list(places)
    inside = [f"_inside_{name}" for name in names]
    found = cells.select(*groups, key, *totals, *buckets, *[ahead(name, [*groups, buckets[-1]], key).alias(label) for name, label in zip(names, inside)])
    for at, bucket in reversed(list(enumerate(buckets))):
        above = [*groups, *buckets[:at][-1:]]
        sums = cells.groupBy(*groups, *buckets[: at + 1][-2:]).agg(*[F.sum(name).alias(name) for name in names])
        offsets = sums.select(*groups, bucket, *[ahead(name, above, bucket).alias(f"_offset_{name}") for name in names])
        found = found.join(offsets, [*groups, bucket]).withColumns({label: F.col(label) + F.col(f"_offset_{name}") for name, label in zip(names, inside)})
        found = found.drop(*[f"_offset_{name}" for name in names])
    before = [F.col(label).alias("keys_before" if name == "_keys" else f"{name}_before") for name, label in zip(names, inside)]
    return found.select(*groups, key, *totals, *before)


def trailing_window(
    df: DataFrame,
    group: str,
    day: str,
    ties: Sequence[str],
    rows: int,
    outputs: dict[str, Callable[[WindowSpec], Column]],
    sizes: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Add columns computed over the ``rows`` rows before each row of its group, ordered by day and ties.

    ``outputs`` maps a new column to a function of the window; rows without a group get null. Groups with more than ``limit``
    rows are numbered together by group and order and cut into chunks of ``limit`` numbers, and each chunk gets copies
    of the last rows before it, so that every row sees the same frame as in one undivided window. How many tasks sort and number
    them depends on their rows alone, not on the limit. ``sizes`` may name a cheaper table to count groups in.
    """
    order = [day, *ties]
    grouped = F.col(group).isNotNull()
    # Rows without a group need no frame; their own key keeps them out of one large partition.
    ungrouped = F.when(~grouped, F.xxhash64(*order))

    def framed(table: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
        frame = Window.partitionBy(*by, ungrouped).orderBy(*order).rowsBetween(-rows, -1)
        return table.withColumns({name: F.when(grouped, make(frame)) for name, make in outputs.items()})

    limit = limit or HOT_ROWS
    large = large_groups(df if sizes is None else sizes, group, limit)
    if large is None:
        return framed(df, [group], order)
    # Written, as the rows are read for the ranges' bounds, for the sort and for the groups left whole.
    marked = stage(df.join(large.select(group, F.lit(True).alias("_large")), group, "left"))
    total = large.agg(F.sum("_rows")).first()[0]
    placed = numbered_rows(marked.where("_large").drop("_large"), [group, *order], total)
    cut = framed(in_chunks(placed, rows, limit), [group, "_chunk"], ["_place"]).where(~F.col("_carried"))
    whole = framed(marked.where("_large IS NULL").drop("_large"), [group], order)
    return whole.unionByName(cut.drop("_place", "_chunk", "_carried")).select(*df.columns, *outputs)


def large_groups(df: DataFrame, group: str, limit: int) -> DataFrame | None:
    """Groups with more than ``limit`` rows and their sizes, a written table; None if there are none. At most (all rows / limit) of them."""

    def counted() -> DataFrame | None:
        sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))
        large = stage(sizes.where(F.col("_rows") > limit))
        return None if large.isEmpty() else large

    return remembered("large", df, [group, limit], counted)


def numbered_rows(df: DataFrame, order: Sequence[str], rows: int) -> DataFrame:
    """Rows with ``_place``, their number in the given order from 0 without gaps; ``rows`` is about how many there are.

    Each task sorts one range and numbers its rows; the ranges' sizes, one short row each, say where a range starts. The numbers
    are written with the rows, so rows equal in all order columns keep theirs; they lie in one range.
    """
    ranges = max(1, -(-rows // RANGE_ROWS))
    ordered = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # The upper bits are the number of the partition, the lower 33 that of the row in it.
    written = stage(ordered.withColumn("_id", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_id", 33))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = written.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    starts = stage(sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")))
    place = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return written.join(starts, "_range").withColumn("_place", place).drop("_id", "_range", "_start")


def in_chunks(placed: DataFrame, rows: int, limit: int) -> DataFrame:
    """Rows with the ``_chunk`` of ``limit`` numbers they lie in, and ``_carried`` copies in those chunks whose first rows look back at them."""

    def chunk(place: Column) -> Column:
        return F.floor(place / F.lit(limit)).cast("bigint")

    home = chunk(F.col("_place"))
    reached = F.sequence(home, chunk(F.col("_place") + F.lit(rows)))
    return placed.withColumn("_chunk", F.explode(reached)).withColumn("_carried", F.col("_chunk") > home)
