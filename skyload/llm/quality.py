"""Quality rules with thresholds read from mergeable quantile sketches per language and source."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyload.llm.common import WHITE, per_text
from skyload.operators.staging import stage

SYMBOLS = b"#*$%&|<>"
#: Relative error of a sketch: a value is off by this share at most.
ERROR = 0.01
#: The sketch of a language weighs as much as so many documents in that of its groups, and the sketch of all in that of a language.
PRIOR = 200


@dataclass(frozen=True)
class Rule:
    """A threshold from two quantiles of a group's sketch: the middle, and so many of its distances to the upper one above it.

    On a scale of ratios a distance is a factor. ``margin`` is the least distance, for groups where both quantiles are equal.
    """

    middle: float
    upper: float
    spreads: float
    margin: float = 0.0
    ratios: bool = False

    def threshold(self, low: Column, high: Column) -> Column:
        if self.ratios:
            return low * F.pow(high / low, F.lit(self.spreads))
        return low + F.greatest(self.spreads * (high - low), F.lit(self.margin))


#: Repeats are zero in most documents, so their spread is read at a quantile that is not. Symbols are counted with half a symbol
#: added: a document without any then has a share that falls with its length, which is how finely shares can be told apart in a group, and
#: the threshold is so many factors above that.
RULES = {
    "symbol_share": Rule(0.5, 0.75, 6.0, ratios=True),
    "repeat_share": Rule(0.5, 0.99, 3.0, 0.2),
    "word_length": Rule(0.5, 0.75, 12.0, 0.5),
    "line_share": Rule(0.5, 0.99, 3.0, 0.3),
}

COUNTS = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,n_lines:long>"
ARROW_COUNTS = pa.struct([(name, pa.int64()) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")])


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more in the text, the first one included."""
    size = len(words)
    if size < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(word, len(number)) for word in words), np.int64, size)
    kinds = len(number)
    if kinds == size:
        return 0
    if kinds < 2_000_000:
        windows = (ids[:-2] * kinds + ids[1:-1]) * kinds + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * kinds + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(size, bool)
    starts = np.concatenate([order[1:][same], order[:-1][same]])
    for shift in range(3):
        twice[starts + shift] = True
    return int(twice.sum())


def count(text: bytes) -> dict:
    words = text.split()
    lines = [line for line in text.split(b"\n") if line and not line.isspace()] if words else []
    return {
        "n_words": len(words),
        "word_chars": len(text.translate(None, WHITE.encode()).decode()),
        "n_symbols": len(text) - len(text.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "n_lines": len(lines),
    }


def measures(c: Column) -> dict[str, Column]:
    words = F.greatest(c["n_words"], F.lit(1))
    return {
        "symbol_share": (c["n_symbols"] + 0.5) / words,
        "repeat_share": c["n_repeat_words"] / words,
        "word_length": c["word_chars"] / words,
        "line_share": c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1)),
    }


def bucket(value: Column) -> Column:
    """Bucket of a value: 0 for values too small to matter, else its logarithm in steps of twice the error."""
    base = float(np.log((1 + ERROR) / (1 - ERROR)))
    return F.when(value < 1e-6, F.lit(0)).otherwise(F.ceil(F.log(value) / base).cast("int") + F.lit(2000))


def bucket_value(number: Column) -> Column:
    base = float(np.log((1 + ERROR) / (1 - ERROR)))
    middle = F.exp((number - 2000) * base) * (1 - ERROR)
    return F.when(number == 0, F.lit(0.0)).otherwise(middle)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, amount) from (lang, source, one column per measure).

    A sketch is a table of counts per logarithmic bucket: sketches merge by adding counts, and a quantile is off by
    ``ERROR`` at most, whatever the order or number of parts. A group holds at most a few thousand buckets.
    """
    parts = F.array(*[F.struct(F.lit(name).alias("measure"), bucket(F.col(name)).alias("bucket")) for name in RULES])
    return (
        rows.select("lang", "source", F.explode(parts).alias("p"))
        .groupBy("lang", "source", "p.measure", "p.bucket")
        .agg(F.count(F.lit(1)).alias("amount"))
    )


def merged(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys, "measure", "bucket").agg(F.sum("amount").alias("amount"))


def pooled(counts: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, share): the share of a group at or below each bucket, drawn towards its language.

    The language's own sketch is drawn towards that of all documents in the same way, so no number of rows switches anything.
    Counts are added up as whole numbers and only then divided, so reruns agree.
    """
    groups = counts.select("lang", "source", "measure").distinct()
    wide = merged(counts, ["lang"]).withColumnsRenamed({"lang": "wide_lang", "measure": "wide_measure"})
    levels = {
        "own": counts,
        "wide": groups.join(wide, F.col("lang").eqNullSafe(F.col("wide_lang")) & (F.col("measure") == F.col("wide_measure"))).drop("wide_lang", "wide_measure"),
        "every": groups.join(merged(counts, []).withColumnRenamed("measure", "every_measure"), F.col("measure") == F.col("every_measure")).drop("every_measure"),
    }
    rows = None
    for level, table in levels.items():
        part = table.select("lang", "source", "measure", "bucket", *[(F.col("amount") if name == level else F.lit(0).cast("long")).alias(name) for name in levels])
        rows = part if rows is None else rows.unionByName(part)
    group = Window.partitionBy("lang", "source", "measure")
    running = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy("lang", "source", "measure", "bucket").agg(*[F.sum(name).alias(name) for name in levels])
    ranked = sums.select(
        "lang", "source", "measure", "bucket",
        *[F.sum(name).over(running).alias(f"{name}_until") for name in levels],
        *[F.sum(name).over(group).alias(f"{name}_n") for name in levels],
    )
    prior = F.lit(float(PRIOR))
    language = (F.col("wide_until") + prior * F.col("every_until") / F.col("every_n")) / (F.col("wide_n") + prior)
    share = (F.col("own_until") + prior * language) / (F.col("own_n") + prior)
    return ranked.select("lang", "source", "measure", "bucket", share.alias("share"))


def adaptive_thresholds(rows: DataFrame) -> DataFrame:
    """(own_lang, own_source, one threshold per measure) from the pooled sketches, see :class:`Rule`."""
    columns = []
    for name, rule in RULES.items():
        at = [F.min(F.when((F.col("measure") == name) & (F.col("share") >= q), F.col("bucket"))) for q in (rule.middle, rule.upper)]
        columns.append(rule.threshold(bucket_value(at[0]), bucket_value(at[1])).alias(f"most_{name}"))
    shares = pooled(stage(sketches(rows)))
    return shares.groupBy(F.col("lang").alias("own_lang"), F.col("source").alias("own_source")).agg(*columns)


def judge_quality(
    docs: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    source_column: str = "source",
    keep: list[str] | None = None,
) -> DataFrame:
    """(row, c, base_failed, failed, kept), one row per row of ``docs``.

    base_failed is the fixed rule: fewer than 50 words, or more than half of them in repeated windows. Other documents
    are kept unless a measure lies above the threshold of their language and source; ``failed`` names such measures. The
    thresholds come from sketches over all documents that pass the fixed rule. Null languages and sources are
    groups of their own; a null text has no words and fails. Repeated rows count as often as they occur, an empty table
    gives an empty result, and the columns of ``docs``, or those that ``keep`` names, stay inside ``row``. The thresholds are a
    written table of one row per language and source, so Spark knows its bytes and need not move the documents for it.
    """
    columns = docs.columns if keep is None else keep
    counted = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in columns]).alias("row"),
        F.col(lang_column).alias("lang"),
        F.col(source_column).alias("source"),
        per_text(count, COUNTS, ARROW_COUNTS)(text_column).alias("c"),
    )
    words = F.col("c.n_words")
    flat = counted.select(
        "row",
        "c",
        "lang",
        "source",
        ((words < 50) | (100 * F.col("c.n_repeat_words") > 50 * words)).alias("base_failed"),
        *[value.alias(name) for name, value in measures(F.col("c")).items()],
    )
    limits = stage(adaptive_thresholds(flat.where("NOT base_failed").select("lang", "source", *RULES)))
    same = F.col("lang").eqNullSafe(F.col("own_lang")) & F.col("source").eqNullSafe(F.col("own_source"))
    judged = flat.join(limits, same, "left").withColumn(
        "failed", F.array_compact(F.array(*[F.when(F.col(name) > F.col(f"most_{name}"), F.lit(name)) for name in RULES]))
    )
    return judged.select("row", "c", "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))
