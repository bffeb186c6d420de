"""Best-fit packing: tokenised documents into sequences; large pieces in pairs, small ones into the tightest gap."""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyload.llm.common import arrow_function, in_groups
from skyload.operators.staging import stage

CAPACITY = 2048
#: Ranks inside one length are counted in so many shares, so a frequent length is spread over tasks.
SHARES = 4096
#: Bytes of words and ids, with what Python adds to each, that a task remembers in one generation; it keeps two.
REMEMBERED = 32 << 20
#: Bytes that a dictionary entry of two short objects takes beside their content.
ENTRY = 200

#: Bytes of text whose words are looked up together.
GROUP = 1 << 20

PIECES = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"
ARROW_PIECES = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))


# Fixed values of the vocabulary's own split pattern, for printable ASCII and the letters from U+00C0 to U+017F. These
# letters are composed and, but for U+0130, have one lower-case letter each, so lower-casing and composing cannot differ.
ODD = re.compile("[^ -~À-ÖØ-öø-įı-ſ]")
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^ a-z0-9ß-öø-ſ]+")


class Recent(dict):
    """A mapping that forgets: when a generation has grown to ``most`` bytes, the one before it goes."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.filled = most, 0
        self.old: dict[str, bytes] = {}

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that are not known; known ones are in the young generation until the next call."""
        if self.filled > self.most:
            self.old, self.filled = dict(self), 0
            self.clear()
        absent, old = keys.difference(self), self.old
        if not old:
            return list(absent)
        again = absent.intersection(old)
        self.learn(again, map(old.__getitem__, again))
        return list(absent - again)

    def learn(self, keys: Iterable[str], values: Iterable[bytes]) -> None:
        for key, value in zip(keys, values):
            self[key] = value
            self.filled += ENTRY + len(key) + len(value)


class WordIds:
    """Ids of texts as little-endian 32-bit bytes.

    The tokenizer drops white space first and never looks across it. Plain words are cut by the vocabulary's split pattern, and
    parts that are new go straight to the model; words with any other character, or where an added token may begin, go through
    the whole tokenizer, many at a time. What is remembered belongs to one task and is bounded in bytes, whatever a word's length.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer_of(path)
        self.model = self.tokenizer.model
        added = {token.content[:2] for token in self.tokenizer.get_added_tokens_decoder().values()}
        self.odd = re.compile("|".join([ODD.pattern, *map(re.escape, sorted(added))]))
        self.parts, self.words = Recent(REMEMBERED), Recent(REMEMBERED)

    def ids_of_words(self, words: list[str]) -> Iterator[bytes]:
        """Tokenise the words in one text and tell by the offsets which ids belong to which."""
        encoded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(encoded.ids, "<u4")
        begins = np.fromiter((begin for begin, _ in encoded.offsets), np.int64, len(ids))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        raw, at = ids.tobytes(), 0
        for cut in (np.searchsorted(begins, np.cumsum(sizes)) * 4).tolist():
            yield raw[at:cut]
            at = cut

    def ids_of_part(self, part: str) -> bytes:
        ids = [token.id for token in self.model.tokenize(byte_signs(part))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def cut(self, text: str) -> list[tuple[list[str], str]]:
        """The text as runs of plain parts, each with the odd word that follows it (empty after the last)."""
        runs, at = [], 0
        for found in self.odd.finditer(text):
            if found.start() >= at:
                start = text.rfind(" ", at, found.start()) + 1 or at
                end = text.find(" ", found.start())
                end = len(text) if end < 0 else end
                runs.append((SPLIT.findall(text[at:start].lower()), text[start:end]))
                at = end
        runs.append((SPLIT.findall(text[at:].lower()), ""))
        return runs

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        split = [self.cut(text.decode().replace("\n", " ")) for text in texts]
        new = self.parts.missing(set().union(*(parts for runs in split for parts, _ in runs)))
        self.parts.learn(new, map(self.ids_of_part, new))
        new = self.words.missing({word for runs in split for _, word in runs})
        self.words.learn(new, self.ids_of_words(new))
        part, word = self.parts.__getitem__, self.words.__getitem__
        return [b"".join([b"".join(map(part, parts)) + word(odd) for parts, odd in runs]) for runs in split]


@cache
def tokenizer_of(path: str):
    """The tokenizer, loaded once per process."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def byte_sign(sign: str) -> str:
    """How the vocabulary writes the bytes of a character."""
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(sign)[0][0]


def byte_signs(part: str) -> str:
    return part if part.isascii() else "".join(map(byte_sign, part))


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the ids) of a document: its ids and a closing 0, cut only above the capacity."""
    ids += b"\0\0\0\0"
    whole, step = len(ids) // 4, capacity * 4
    return [
        (number, number * capacity, min(capacity, whole - number * capacity), zlib.crc32(ids[number * step : (number + 1) * step]))
        for number in range((whole + capacity - 1) // capacity)
    ]


@dataclass
class Slot:
    """So many consecutive pieces of one length: ``each`` per sequence, from ``first`` on, at ``offset`` in each."""

    length: int
    low: int
    high: int
    first: int
    each: int
    offset: int


def plan(counts: dict[int, int], capacity: int) -> list[Slot]:
    """Where the pieces of each length go, from their counts alone.

    Pieces above a third of the capacity fit at most twice: from the longest down, each takes as its partner the
    longest such piece that still fits. Smaller pieces follow in falling length; each goes to the sequence with the
    smallest gap that holds it, or opens a new one. Equal sequences are handled together, so the work
    and the result depend on the number of lengths (at most the capacity), not on the number of pieces.
    """
    left = {length: count for length, count in counts.items() if count > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    slots: list[Slot] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens: (first sequence, number of sequences)
    sizes: list[int] = []
    opened = 0

    def put(length: int, first: int, sequences: int, each: int, free: int) -> None:
        amount = sequences * each
        slots.append(Slot(length, used[length], used[length] + amount, first, each, capacity - free))
        used[length] += amount
        left[length] -= amount

    def leave(free: int, first: int, sequences: int) -> None:
        if free and sequences:
            if free not in gaps:
                gaps[free] = []
                insort(sizes, free)
            gaps[free].append((first, sequences))

    large = sorted(length for length in left if 3 * length > capacity)
    for length in reversed(large):
        while left[length]:
            partner = next((p for p in reversed(large[: bisect_left(large, capacity - length + 1)]) if left[p] and (p != length or left[p] > 1)), None)
            if partner is None:
                number = left[length]
                put(length, opened, number, 1, capacity)
            elif partner == length:
                number = left[length] // 2
                put(length, opened, number, 2, capacity)
            else:
                number = min(left[length], left[partner])
                put(length, opened, number, 1, capacity)
                put(partner, opened, number, 1, capacity - length)
            leave(capacity - length - (partner or 0), opened, number)
            opened += number
    for length in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                each = min(capacity // length, left[length])
                number = max(1, left[length] // each)
                put(length, opened, number, each, capacity)
                leave(capacity - each * length, opened, number)
                opened += number
                continue
            free = sizes[at]
            first, sequences = gaps[free].pop()
            if not gaps[free]:
                del gaps[free], sizes[at]
            each = min(free // length, left[length])
            number = min(sequences, left[length] // each)
            put(length, first, number, each, free)
            leave(free - each * length, first, number)
            leave(free, first + number, sequences - number)
    return slots


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; a null text is empty and gives one piece of one id."""

    def pieces(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = WordIds(tokenizer)  # goes with the task
        for column in columns:
            groups = [pa.array([cut(ids, capacity) for ids in words.encode(group)], ARROW_PIECES) for group in in_groups(column, GROUP)]
            yield pa.concat_arrays(groups) if groups else pa.array([], ARROW_PIECES)

    rows = docs.select(F.col(id_column).alias("doc_id"), F.explode(arrow_function(pieces, PIECES)(text_column)).alias("p"))
    return rows.select("doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    The pieces are written once. The driver sees one count per length, at most ``capacity`` of them, and plans from these; the
    plan, whose size depends on the capacity alone, is joined back by length and by the rank of a piece within its
    length. Ranks come from windows over small shares of a length plus the sums of the shares before, so
    a frequent length is spread over many tasks. Repeated rows are packed as often as they occur, ties of rank are broken by crc,
    null ids are allowed, an empty table gives no piece. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    share = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SHARES)).cast("int")
    pieces = stage(pieces_of(docs, tokenizer, capacity, id_column, text_column).withColumn("share", share))
    shares = pieces.groupBy("length", "share").agg(F.count(F.lit(1)).alias("amount"))
    counts = {row["length"]: row["amount"] for row in shares.groupBy("length").agg(F.sum("amount").alias("amount")).collect()}
    slots = [(s.length, s.low, s.high, s.first, s.each, s.offset) for s in plan(counts, capacity)]
    placed = spark.createDataFrame(slots, "slot_length long, low long, high long, first long, each long, base long")
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    starts = shares.select("length", "share", F.coalesce(F.sum("amount").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.join(starts, ["length", "share"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1)
    here = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    nth = F.col("rank") - F.col("low")
    return ranked.join(F.broadcast(placed), here).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("base") + nth % F.col("each") * F.col("length")).alias("offset"),
    )
