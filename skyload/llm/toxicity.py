"""Toxicity: a weighted lexicon found by Aho-Corasick in folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyload.llm.common import arrow_function, per_text, texts
from skyload.operators.staging import stage

#: Labelled documents that the lexicon is learned from, at most so many of each class, chosen by a hash of the id.
TOXIC_ROWS, CLEAN_ROWS = 4000, 8000
#: Entries of the lexicon, and exception phrases, at most.
MOST_TERMS, MOST_PHRASES = 5000, 2000
#: A term must occur in so many toxic documents of the sample, and in this share of them.
LEAST_DOCUMENTS, LEAST_SHARE = 3, 0.005
#: Least logarithm of the odds for a term of the lexicon.
LEAST_WEIGHT = 2.0
#: Terms are whole words, or stems: the first so many letters of longer words.
STEMS = range(4, 9)

# Letters of other alphabets that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ь": "b",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u",
    "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Letters that one substitute can stand for are made one, in lexicon and text alike.
SAME = {"l": "i", "|": "i"}


def folding() -> dict[int, str | None]:
    """The table that folds a text: case, accents, wide forms, look-alikes and substitutes; other ASCII signs part words."""
    table: dict[int, str | None] = {}
    for code in [*range(0x80), *range(0xA0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        mark = chr(code)
        base = unicodedata.normalize("NFKD", mark).lower()[:1] or " "
        base = LOOKALIKES.get(mark.lower(), LOOKALIKES.get(base, base))
        base = SAME.get(SUBSTITUTES.get(base, base), SUBSTITUTES.get(base, base))
        table[code] = base if base.isalnum() else " "
    # Invisible characters inside words, and combining accents, vanish.
    for code in [0xAD, *range(0x300, 0x370), *range(0x200B, 0x2010), 0x2060, 0xFEFF]:
        table[code] = None
    return table


FOLDED = folding()


def fold(text: str) -> str:
    return " " + text.translate(FOLDED) + " "


def terms_of(text: bytes) -> list[str]:
    """The distinct terms of a text: ' word ' for a word, ' stem' for the beginning of one."""
    found = set()
    for word in set(fold(text.decode()).split()):
        if len(word) >= 3 and len(word) <= 40:
            found.add(f" {word} ")
            found.update(f" {word[:size]}" for size in STEMS if size < len(word))
    return list(found)


@dataclass
class Lexicon:
    """Weights by folded term, folded phrases that excuse the terms inside them, and the curve from features to a score."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = (-6.0, 1.0, 1.0)
    machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"terms": self.terms, "exceptions": self.exceptions, "curve": self.curve, "machine": None}

    def automaton(self):
        if self.machine is None:
            machine = ahocorasick.Automaton()
            entries: dict[str, list] = {}
            for term, weight in self.terms.items():
                entries.setdefault(term, [0.0, False])[0] = weight
            for phrase in self.exceptions:
                entries.setdefault(phrase, [0.0, False])[1] = True
            for entry, (weight, excuses) in entries.items():
                machine.add_word(entry, (len(entry), weight, excuses))
            machine.make_automaton()
            self.machine = machine
        return self.machine

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the matches that lie in no exception phrase; of matches that begin together, the heaviest."""
        if not self.terms:
            return []
        best: dict[int, tuple[int, float]] = {}
        excused: list[tuple[int, int]] = []
        for last, (size, weight, excuses) in self.automaton().iter(folded):
            start = last - size + 1
            if excuses:
                excused.append((start, last + 1))
            if weight and weight > best.get(start, (0, 0.0))[1]:
                best[start] = (last + 1, weight)
        if excused:
            best = {s: found for s, found in best.items() if not any(a <= s and found[0] <= b for a, b in excused)}
        return [(start, end, weight) for start, (end, weight) in sorted(best.items())]

    def features(self, text: bytes) -> tuple[float, float]:
        """The weight found, as a logarithm, and per word of the text; a term said over and over adds less each time."""
        folded = fold(text.decode())
        times: Counter = Counter()
        for start, end, weight in self.hits(folded):
            times[folded[start:end], weight] += 1
        if not times:
            return 0.0, 0.0
        total = sum(weight * math.log2(1 + count) for (_, weight), count in times.items())
        return math.log1p(total), total / (5 + folded.count(" "))

    def score(self, text: bytes) -> float:
        if not self.terms:
            return 0.0
        bias, amount, density = self.curve
        x, y = self.features(text)
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, bias + amount * x + density * y))))


def held_out(id_column: Column) -> Column:
    """Whether a row is never learned from: crc32 of the id as text divides by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str) -> DataFrame:
    """(text, toxic) of a bounded sample of the labelled rows; each text once."""
    known = labels.select(F.col(id_column).alias("label_id"), F.col(label_column).alias("toxic")).where("label_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("label_id", F.lit(7))
    chosen = known.where("toxic = 1").orderBy(order, "label_id").limit(TOXIC_ROWS).unionByName(
        known.where("toxic = 0").orderBy(order, "label_id").limit(CLEAN_ROWS)
    )
    # At most TOXIC_ROWS + CLEAN_ROWS pairs of numbers are broadcast; the texts stay where they are read.
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    found = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).where("text IS NOT NULL")
    once = found.select("text", "toxic", F.xxhash64("text").alias("mark")).dropDuplicates(["mark", "toxic"])
    return stage(once.select("text", "toxic"))


def weigh(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Weights of (term, toxic documents, clean documents) that mark toxic text; the first document of a term counts a tenth."""
    found = {}
    for term, bad, good in counts:
        if toxic and bad >= max(LEAST_DOCUMENTS, LEAST_SHARE * toxic):
            weight = math.log((bad - 0.9) / (toxic + 1)) - math.log((good + 0.5) / (clean + 1))
            if weight >= LEAST_WEIGHT:
                found[term] = (weight, bad)
    kept = {}
    for term, (weight, bad) in found.items():
        # A stem that is nearly as pure and matches more documents says the same more generally.
        stems = [term[: size + 1] for size in STEMS if size + 1 < len(term.rstrip())]
        if not any(stem in found and found[stem][0] >= weight - 0.5 and found[stem][1] >= bad for stem in stems):
            kept[term] = weight
    return kept


def learn_terms(rows: DataFrame) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """Three sets of weights: from all rows, and as they would be without one toxic row, or one clean row, that has the term.

    The last two tell what the lexicon would find in a document that it was not learned from. Documents per term are
    counted in Spark; only the ``MOST_TERMS`` most telling reach the driver.
    """
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    split = per_text(terms_of, "array<string>", pa.list_(pa.string()))
    counted = rows.select("toxic", F.explode(split("text")).alias("term")).groupBy("term").agg(
        F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good")
    )
    odds = F.log((F.col("bad") - 0.9) / (toxic + 1.0)) - F.log((F.greatest(F.col("good") - 1, F.lit(0)) + 0.5) / (clean + 1.0))
    strong = counted.where(F.col("bad") >= max(LEAST_DOCUMENTS, LEAST_SHARE * toxic)).withColumn("weight", odds)
    best = strong.where(F.col("weight") >= LEAST_WEIGHT).orderBy(F.desc("weight"), "term").limit(MOST_TERMS).collect()
    counts = [(r["term"], r["bad"], r["good"]) for r in best]
    return (
        weigh(counts, toxic, clean),
        weigh([(term, bad - 1, good) for term, bad, good in counts], toxic - 1, clean),
        weigh([(term, bad, max(0, good - 1)) for term, bad, good in counts], toxic, clean - 1),
    )


def phrases_of(lexicon: Lexicon, text: bytes) -> list[str]:
    """The matched words of a text with the word before, and with the word after."""
    folded = fold(text.decode())
    found = set()
    for start, _, _ in lexicon.hits(folded):
        word_end = folded.find(" ", start + 1)
        before = folded.rfind(" ", 0, start - 1) if start > 1 else -1
        if before >= 0 and folded[before + 1 : start].strip():
            found.add(folded[before : word_end + 1])
        after = folded.find(" ", word_end + 1)
        if after > word_end + 1:
            found.add(folded[start : after + 1])
    return [phrase for phrase in found if re.fullmatch(r" \S+ \S+ ", phrase)]


def learn_exceptions(rows: DataFrame, lexicon: Lexicon) -> tuple[str, ...]:
    """Two-word phrases around a term that occur in some clean documents of the sample and in no toxic one."""
    if not lexicon.terms:
        return ()
    split = per_text(lambda text: phrases_of(lexicon, text), "array<string>", pa.list_(pa.string()))
    counted = rows.select("toxic", F.explode(split("text")).alias("phrase")).groupBy("phrase").agg(
        F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("every")
    )
    found = counted.where((F.col("bad") == 0) & (F.col("every") >= LEAST_DOCUMENTS)).orderBy(F.desc("every"), "phrase").limit(MOST_PHRASES).collect()
    return tuple(r["phrase"] for r in found)


def fit_curve(features: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small penalty."""
    design = np.column_stack([np.ones(len(features)), features])
    weights = np.zeros(design.shape[1])
    penalty = np.diag([1e-6, 0.02, 0.02])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(3), design.T @ (toxic - p) - penalty @ weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(w) for w in weights)


def learn_lexicon(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
    exceptions: tuple[str, ...] = (),
) -> Lexicon:
    """A lexicon from labelled documents that are not held out; without toxic labels it is empty and every score is 0.

    ``exceptions`` are further phrases that excuse what they contain. The sample is bounded by ``TOXIC_ROWS`` and
    ``CLEAN_ROWS``; the driver sees the chosen terms and two numbers per sampled document.
    """
    rows = training_rows(docs, labels, id_column, text_column, label_column)
    whole, without_toxic, without_clean = learn_terms(rows)
    given = tuple(" " + " ".join(fold(phrase).split()) + " " for phrase in exceptions)
    if not whole:
        return Lexicon({}, given)
    excused = given + learn_exceptions(rows, Lexicon(whole, given))
    shape = pa.struct([("amount", pa.float64()), ("density", pa.float64())])
    points, toxic = [], []
    # The curve is fitted to what a lexicon finds in a document that it has not been learned from.
    for label, terms in ((1, without_toxic), (0, without_clean)):
        measured = per_text(Lexicon(terms, excused).features, "struct<amount:double,density:double>", shape)
        for r in rows.where(F.col("toxic") == label).select(measured("text").alias("f")).select("f.amount", "f.density").collect():
            points.append((r["amount"], r["density"]))
            toxic.append(float(label))
    return Lexicon(whole, excused, fit_curve(np.array(points), np.array(toxic)))


def score_text(text: Column | str, lexicon: Lexicon) -> Column:
    """The score of a text, 0 to 1; null counts as empty."""

    def apply(column: pa.Array) -> pa.Array:
        return pa.array([lexicon.score(value) for value in texts(column)], pa.float64())

    return arrow_function(apply, "double")(text)


def score_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``.

    The score sees the text alone. Null and empty texts get the score of a text without a match. Repeated rows get the same
    score, null ids are allowed and count as held out; an empty table gives an empty result. Labels that are null, or
    of ids that do not occur, are not used; an id labelled both ways counts as toxic. Other columns are not read.
    """
    lexicon = learn_lexicon(docs, labels, id_column, text_column)
    rows = docs.select(F.col(id_column).alias("doc_id"), score_text(F.col(text_column), lexicon).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below one half, with their columns."""
    lexicon = learn_lexicon(docs, labels, id_column, text_column)
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row")
    return docs.select(row, score_text(F.col(text_column), lexicon).alias("score")).where("score < 0.5").select("row.*")
