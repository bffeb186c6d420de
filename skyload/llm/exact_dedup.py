"""Exact duplicates: 128-bit content hash, a kept row per class, bytes compared inside each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyload.llm.common import WHITE
from skyload.operators.staging import stage


def without_white_space(text: Column) -> Column:
    """The text without its ASCII white space; null counts as empty."""
    value = F.coalesce(text, F.lit(""))
    for mark in WHITE:
        value = F.replace(value, F.lit(mark), F.lit(""))
    return value


def exact_classes(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digest: Callable[[Column], Column] = F.md5
) -> DataFrame:
    """(doc_id, n_chars, digest, text_sha256, keep_id, keep_chars, group_size, kept), one row per row of ``docs``.

    Rows are grouped by the 128-bit ``digest`` and by the normalised text itself: Spark compares the bytes of both
    grouping keys, so texts that only share a digest stay apart. Copies are merged before the shuffle, so a group
    of any size sends one row per task. Of each group the row with the longest original text
    stays, then the smallest id; a null id is the largest. The text travels once; rows find their group by digest and
    SHA-256 of the text, without carrying it.

    A null text is empty, and all empty or white texts are one class. Rows with the same id and text are equal in
    every column here, so all of them count as kept; ``drop_exact_copies`` leaves one. An empty table gives an
    empty result; columns other than the two named are not read.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    normal = without_white_space(F.col("text"))
    length = F.char_length(F.coalesce("text", F.lit("")))
    rank = F.struct((-length).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id")
    groups = (
        source.select(normal.alias("normal"), rank.alias("rank"))
        .withColumn("digest", digest(F.col("normal")))
        .groupBy("digest", "normal")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min("rank").alias("best"))
        .select(
            "digest",
            F.sha2("normal", 256).alias("text_sha256"),
            F.col("best.doc_id").alias("keep_id"),
            (-F.col("best.shorter")).alias("keep_chars"),
            "group_size",
        )
    )
    rows = (
        source.select("doc_id", length.alias("n_chars"), normal.alias("normal"))
        .select("doc_id", "n_chars", digest(F.col("normal")).alias("digest"), F.sha2("normal", 256).alias("text_sha256"))
    )
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    return rows.join(groups, ["digest", "text_sha256"]).withColumn("kept", stays)


def drop_exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_classes` keeps, with all their columns.

    The kept ids are written as a small table and joined back on id and SHA-256. If a table holds the very same row
    several times, one of these rows stays; the small table says whether that happens at all.
    """
    classes = exact_classes(docs, id_column, text_column).where("kept")
    kept = stage(classes.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("times")))
    named = kept.select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_sha256"), "times")
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
        F.col(id_column).alias("doc_id"),
        F.sha2(without_white_space(F.col(text_column)), 256).alias("text_sha256"),
    )
    own = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_sha256") == F.col("keep_sha256"))
    # A kept id can come twice with one class: only the row with the longest text is the kept one then.
    found = rows.join(named, own)
    if kept.where("times > 1").isEmpty() and docs.groupBy(id_column).count().where("count > 1").isEmpty():
        return found.select("row.*")
    longest = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy(F.char_length(F.col(f"row.`{text_column}`")).desc()))
    return found.withColumn("nth", longest).where("nth = 1").select("row.*")
