"""Repeated lines or paragraphs: units are normalised and hashed, the earliest stays, the rest are removed by offset."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyload.llm.common import arrow_function, per_text
from skyload.operators.staging import stage

UNITS = "array<struct<unit:int,start:int,end:int,digest:binary>>"
ARROW_UNITS = pa.list_(pa.struct([("unit", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.binary())]))
LINE = re.compile(r"[^\n]+")
PARAGRAPH = re.compile(r"[^\n]+(?:\n[^\n]+)*")
#: Where a sentence ends, with the white space after it.
SENTENCE_END = re.compile("[.!?]+[ \t]+|[。！？]+")
#: Units of this many code points or more are cut into sentences; one shorter than the second number stays with the next.
LONG_UNIT, SHORT_SENTENCE = 200, 20
#: Adjoining removed units of so many code points together are reported as a passage.
PASSAGE = 100


def cut_long(unit: str) -> Iterator[tuple[int, int]]:
    """Places of the parts of a unit: itself, or if it is long its sentences, short ones together with the one that follows.

    Whether a sentence ends a part depends on that sentence alone, so a passage copied from the middle of one long line into the middle
    of another is cut at the same places in both.
    """
    at = previous = 0
    if len(unit) >= LONG_UNIT:
        for end in SENTENCE_END.finditer(unit):
            if end.end() - previous >= SHORT_SENTENCE:
                yield at, end.end()
                at = end.end()
            previous = end.end()
    if at < len(unit):
        yield at, len(unit)


def units_of(text: bytes, pattern: re.Pattern) -> Iterator[tuple[int, int, int, bytes]]:
    """(number, start, end, digest) of the units; offsets are code points of the original text, the end excluded."""
    number = 0
    for found in pattern.finditer(text.decode()):
        for start, end in cut_long(found.group()):
            words = found.group()[start:end].lower().encode().split()
            if words:
                yield number, found.start() + start, found.start() + end, xxhash.xxh3_128_digest(b" ".join(words))
            number += 1


def repeated_units(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", unit: str = "line") -> DataFrame:
    """(doc_id, text_hash, unit, start, end, first_id): every unit that occurs earlier, with its offsets.

    A unit is a line, or a paragraph (lines without an empty one between them); if long, each of its sentences, see
    :func:`cut_long`. It is lower-cased and its white space made single before a 128-bit digest is taken; units of white space alone
    are none, all others count however short. Of each digest the occurrence of the smallest (doc_id, text hash,
    start) is kept; a null id comes first; rows equal in id and text are one row, so none of them loses a unit to the other.
    First occurrences are aggregated before the shuffle and those of repeated digests written; the join back on the digest is then one of
    two plain tables: sent to all tasks below Spark's broadcast limit, else shuffled, where adaptive execution splits a heavy digest.
    """
    pattern = {"line": LINE, "paragraph": PARAGRAPH}[unit]
    cut = per_text(lambda text: list(units_of(text, pattern)), UNITS, ARROW_UNITS)
    rows = (
        docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(cut("text")).alias("u"))
        .select("doc_id", "text_hash", "u.unit", "u.start", "u.end", "u.digest")
    )
    place = F.struct("doc_id", "text_hash", "start")
    firsts = stage(
        rows.groupBy("digest")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last")))
        .select("digest", "first")
    )
    return (
        rows.join(firsts, "digest")
        .where(~place.eqNullSafe(F.col("first")))
        .select("doc_id", "text_hash", "unit", "start", "end", F.col("first.doc_id").alias("first_id"))
    )


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", unit: str = "line") -> DataFrame:
    """(doc_id, n_chars, n_removed, removed_chars, passage_chars, removed, kept_text), one row per row of ``docs``.

    ``removed`` lists the removed spans (unit, start, end, first_id) in the order of the text, with offsets into the
    original text; ``kept_text`` is what is left, with the line breaks as they were; ``passage_chars`` is the length of the
    runs of removed units with nothing but a line break between them, as far as a run has ``PASSAGE`` code points or more, which tells copied
    passages from scattered short repeats. Null texts are empty and lose nothing. Rows that share id and text are the same row several times: each is returned, with the
    same spans. Ids may be of any type that has an order. The other columns of ``docs`` are not read.
    """
    spans = (
        repeated_units(docs, id_column, text_column, unit)
        .groupBy(F.col("doc_id").alias("span_id"), F.col("text_hash").alias("span_hash"))
        .agg(F.array_sort(F.collect_set(F.struct("unit", "start", "end", "first_id"))).alias("removed"))
    )
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("text_hash") == F.col("span_hash"))
    none = F.array().cast(spans.schema["removed"].dataType)
    joined = rows.join(spans, same, "left").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("removed", none).alias("removed")
    )

    def left(text: str, cuts: list[dict]) -> str:
        at, parts = 0, []
        for cut in cuts:
            parts.append(text[at : cut["start"]])
            at = cut["end"]
        return "".join(parts) + text[at:]

    def left_over(whole: pa.Array, removed: pa.Array) -> pa.Array:
        """A few hundred texts at a time as Python objects."""
        groups = [pa.array([left(*pair) for pair in zip(whole[at : at + 256].to_pylist(), removed[at : at + 256].to_pylist())], pa.string()) for at in range(0, len(whole), 256)]
        return pa.concat_arrays(groups) if groups else pa.array([], pa.string())

    kept_text = arrow_function(left_over, "string")("text", "removed")
    sizes = F.transform("removed", lambda cut: cut["end"] - cut["start"])
    zero = F.lit(0).cast("long")

    def passage(run: Column) -> Column:
        length = run["end"] - run["start"]
        return run["total"] + F.when(length >= PASSAGE, length).otherwise(0)

    def grown(run: Column, cut: Column) -> Column:
        apart = cut["start"] - run["end"] > 1
        return F.struct(
            F.when(apart, cut["start"]).otherwise(run["start"]).cast("long").alias("start"),
            cut["end"].cast("long").alias("end"),
            F.when(apart, passage(run)).otherwise(run["total"]).alias("total"),
        )

    nothing = F.struct(zero.alias("start"), F.lit(-9).cast("long").alias("end"), zero.alias("total"))
    return joined.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.size("removed").cast("long").alias("n_removed"),
        F.aggregate(sizes, F.lit(0).cast("long"), lambda total, size: total + size).alias("removed_chars"),
        F.aggregate("removed", nothing, grown, passage).alias("passage_chars"),
        "removed",
        F.when(F.size("removed") == 0, F.col("text")).otherwise(kept_text).alias("kept_text"),
    )
