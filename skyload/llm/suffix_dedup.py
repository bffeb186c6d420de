"""Repeated byte strings: suffix arrays over shards of text that can match, found by anchors that equal strings share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyload.llm.common import arrow_function, show_package_to_workers, texts
from skyload.llm.suffix_order import repeated_starts
from skyload.operators.staging import stage

#: Strings of so many bytes count as repeated.
LENGTH = 100
#: Bytes of an anchor: every string of LENGTH bytes is filed under the anchor in it with the smallest hash.
ANCHOR = 24
#: Bytes of text hashed at a time, and bytes sorted at a time.
BLOCK, SHARD = 1 << 18, 1 << 20

_draw = np.random.Generator(np.random.PCG64(20240607))
BYTE_HASH = _draw.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = _draw.integers(0, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)

FRAGMENTS = "key long, mark long, doc long, start int, number int"
ARROW_FRAGMENTS = pa.schema([("key", pa.int64()), ("mark", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("number", pa.int32())])
SPANS = "key long, doc long, start int, number int"
ARROW_SPANS = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("number", pa.int32())])

PARTS = "key long, doc long, start int, bytes binary"
ARROW_PARTS = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("bytes", pa.binary())])


def anchor_hashes(block: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each position on, by joining hashes of 1, 2, 4, 8 and 16 bytes."""
    value, size, eight = BYTE_HASH[block], 1, None
    for factor in FACTORS[:4]:
        joined = value * factor
        joined[: len(value) - size] += value[size:]
        value, size = joined, size * 2
        if size == 8:
            eight = value
    total = value * FACTORS[4]
    total[: len(eight) - 16] += eight[16:]
    total ^= total >> np.uint64(32)
    total *= FACTORS[5]
    total ^= total >> np.uint64(29)
    return total


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each position on; the last positions see what is left."""
    out, size = values, 1
    while size * 2 <= width:
        longer = out.copy()
        np.minimum(out[:-size], out[size:], out=longer[:-size])
        out, size = longer, size * 2
    rest = width - size
    if rest:
        longer = out.copy()
        np.minimum(out[:-rest], out[rest:], out=longer[:-rest])
        out = longer
    return out


def cut_block(block: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(piece, position, number, key) of the fragments in texts that lie in ``block`` one after the other.

    A fragment is a run of string starts that share their anchor, so equal strings are filed under equal keys.
    """
    counts = np.maximum(sizes - LENGTH + 1, 0)
    places = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    hashes = anchor_hashes(block)
    packed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(block), dtype=np.uint64)
    anchors = (least_in_window(packed, LENGTH - ANCHOR + 1)[places] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (places[1:] != places[:-1] + 1)])
    heads = np.flatnonzero(new)
    numbers = np.diff(np.append(heads, len(places)))
    pieces = np.repeat(np.arange(len(sizes)), counts)[heads]
    return pieces, places[heads], numbers, hashes[anchors[heads]]


def settle_block(keys: np.ndarray, marks: np.ndarray, docs: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> list[np.ndarray]:
    """The fragments of a block with copies settled before the shuffle: of equal ones the first in (doc, start) stays.

    The others are repeated as a whole. Runs of them are joined and go on with a negative number, under a key that
    depends on their document, so that neither very common passages nor one word said over and over fill a key.
    """
    order = np.argsort(marks, kind="stable")
    equal = marks[order][1:] == marks[order][:-1]
    if not equal.any():
        return [keys, marks, docs, starts, numbers]
    several = order[np.concatenate([[False], equal]) | np.concatenate([equal, [False]])]
    several = several[np.lexsort((starts[several], docs[several], marks[several]))]
    copy = np.zeros(len(marks), bool)
    copy[several[1:][marks[several][1:] == marks[several][:-1]]] = True
    at = np.flatnonzero(copy)
    ends = starts[at] + numbers[at]
    joins = (at[1:] == at[:-1] + 1) & (docs[at][1:] == docs[at][:-1]) & (starts[at][1:] == ends[:-1])
    heads, tails = np.flatnonzero(np.concatenate([[True], ~joins])), np.flatnonzero(np.concatenate([~joins, [True]]))
    owner, begin = docs[at][heads], starts[at][heads]
    spread = owner * np.int64(-7046029254386353131) + begin
    live = ~copy
    return [
        np.concatenate(pair)
        for pair in (
            (keys[live], spread), (marks[live], np.zeros(len(heads), np.int64)), (docs[live], owner), (starts[live], begin),
            (numbers[live], begin - ends[tails]),
        )
    ]


def cut_texts(docs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """The fragments of whole texts; a text longer than a block is cut into parts that overlap by all but one byte of a string."""
    parts: list[tuple[int, int, bytes]] = []
    filled = 0

    def flush() -> pa.RecordBatch:
        whole = b"".join(part for _, _, part in parts)
        sizes = np.array([len(part) for _, _, part in parts])
        starts = np.cumsum(sizes) - sizes
        pieces, places, numbers, keys = cut_block(np.frombuffer(whole, np.uint8), starts, sizes)
        mark = xxhash.xxh3_64_intdigest
        ends = places + numbers + (LENGTH - 1)
        marks = np.fromiter((mark(whole[a:b]) for a, b in zip(places.tolist(), ends.tolist())), np.uint64, len(places))
        ids, offsets = np.array([doc for doc, _, _ in parts]), np.array([offset for _, offset, _ in parts])
        columns = settle_block(keys.view(np.int64), marks.view(np.int64), ids[pieces], places - starts[pieces] + offsets[pieces], numbers)
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, ARROW_FRAGMENTS.types)], schema=ARROW_FRAGMENTS)

    for doc, text in docs:
        for at in range(0, max(len(text) - LENGTH + 1, 0), BLOCK):
            part = text[at : at + BLOCK + LENGTH - 1]
            parts.append((doc, at, part))
            filled += len(part)
            if filled >= BLOCK:
                yield flush()
                parts, filled = [], 0
    if parts:
        yield flush()


def fragments(numbered: DataFrame) -> DataFrame:
    """(key, mark, doc, start, number): runs of ``number`` string starts filed under ``key``, with a hash of all their bytes.

    Runs with a negative number are known to be repeated as a whole already.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from cut_texts(list(zip(batch.column("doc").to_pylist(), texts(batch.column("text")))))

    return numbered.select("doc", "text").mapInArrow(cut, FRAGMENTS)


def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments in the order of key, mark, doc, start to (key, doc, start, number); settled ones pass.

    Every copy of a fragment but the first is repeated as a whole: key null. A first copy whose key has other
    fragments may share strings with them: it keeps its key. A fragment alone under its key has no repeated string. Only the
    last row and the last first copy are remembered, whatever the size of a group.
    """
    last = None
    pending = None  # the last first copy, and whether the one before has its key
    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        key, mark, doc, start, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        settled = number < 0
        out = [(pa.nulls(int(settled.sum()), pa.int64()), doc[settled], start[settled], -number[settled])]
        key, mark, doc, start, number = (column[~settled] for column in (key, mark, doc, start, number))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
        if last is not None and len(key):
            new[0] = (key[0], mark[0]) != last
        if len(key):
            last = (key[-1], mark[-1])
        copies, heads = np.flatnonzero(~new), np.flatnonzero(new)
        out.append((pa.nulls(len(copies), pa.int64()), doc[copies], start[copies], number[copies]))
        if len(heads):
            keys = key[heads]
            same = np.zeros(len(heads) + 1, bool)
            same[1:-1] = keys[1:] == keys[:-1]
            if pending is not None:
                same[0] = keys[0] == pending[0]
                if same[0] or pending[4]:
                    out.append(tuple(pa.array([value], kind) for value, kind in zip(pending[:4], ARROW_SPANS.types)))
            shared = heads[:-1][(same[:-1] | same[1:])[:-1]]
            out.append((key[shared], doc[shared], start[shared], number[shared]))
            end = heads[-1]
            pending = (int(key[end]), int(doc[end]), int(start[end]), int(number[end]), bool(same[-2]))
        for columns in out:
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, ARROW_SPANS.types)], schema=ARROW_SPANS)
    if pending is not None and pending[4]:
        yield pa.RecordBatch.from_arrays([pa.array([value], kind) for value, kind in zip(pending[:4], ARROW_SPANS.types)], schema=ARROW_SPANS)


def sort_shard(parts: list[bytes], seen: np.ndarray | None) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
    """(runs of repeated starts of each fragment, hashes of the strings): all fragments of some keys, in order of doc and start.

    ``seen`` holds the hashes of strings of earlier shards, if a key has more fragments than one shard holds.
    """
    whole = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(part) for part in parts])
    starts = np.cumsum(sizes) - sizes
    counts = sizes - LENGTH + 1
    edge = np.zeros(len(whole) + 1, np.int64)
    edge[starts] += 1
    edge[starts + counts] -= 1
    valid = np.cumsum(edge[:-1]) > 0
    repeated, first = repeated_starts(whole, valid, LENGTH)
    hashes = np.zeros(0, np.uint64)
    if seen is not None:
        raw = whole.tobytes()
        places = np.flatnonzero(first)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : a + LENGTH]) for a in places.tolist()), np.uint64, len(places))
        # A string that an earlier shard holds is repeated wherever it stands in this one.
        repeated[places[np.isin(hashes, seen)]] = True
    steps = np.diff(np.concatenate([[0], repeated.view(np.int8), [0]]))
    begins, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    owner = np.searchsorted(starts, begins, "right") - 1
    runs: list[list[tuple[int, int]]] = [[] for _ in parts]
    for part, begin, end in zip(owner.tolist(), begins.tolist(), ends.tolist()):
        runs[part].append((begin - int(starts[part]), end - begin))
    return runs, hashes


def sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, start, bytes) in the order of key, doc, start to spans of repeated starts, shard by shard.

    A shard holds whole keys; a key with more text than a shard is taken in several, which pass on hashes of its strings.
    """
    rows: list[tuple[int, int, int, bytes]] = []
    filled = 0
    seen: np.ndarray | None = None
    seen_key: int | None = None

    def finish(part: list, carry: bool) -> pa.RecordBatch:
        nonlocal seen
        runs, hashes = sort_shard([text for *_, text in part], seen if carry else None)
        if carry:
            seen = np.union1d(seen, hashes)
        spans = [(doc, start + at, number) for (_, doc, start, _), found in zip(part, runs) for at, number in found]
        columns = list(zip(*spans)) or [(), (), ()]
        arrays = [pa.nulls(len(spans), pa.int64()), *[pa.array(column, kind) for column, kind in zip(columns, ARROW_SPANS.types[1:])]]
        return pa.RecordBatch.from_arrays(arrays, schema=ARROW_SPANS)

    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if filled >= SHARD and row[0] != rows[-1][0]:
                yield finish(rows, rows[0][0] == seen_key)
                rows, filled = [], 0
            elif filled >= 4 * SHARD:
                # The last key goes on: what came before it is finished, the key itself is passed on in parts.
                key = row[0]
                head = [r for r in rows if r[0] != key]
                if head:
                    yield finish(head, head[0][0] == seen_key)
                if seen_key != key:
                    seen, seen_key = np.zeros(0, np.uint64), key
                yield finish([r for r in rows if r[0] == key], True)
                rows, filled = [], 0
            rows.append(row)
            filled += len(row[3])
    if rows:
        tail = [r for r in rows if r[0] == seen_key]
        rest = [r for r in rows if r[0] != seen_key]
        if tail:
            yield finish(tail, True)
        if rest:
            yield finish(rest, False)


def numbered_docs(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, bool]:
    """(doc, text), or (doc, doc_id, text) and True, with a number per row in the order of the ids.

    The number is the id itself if ids are whole numbers, unique and not null. Else rows are ordered by id, null first, then
    by a hash of the text, range by range; equal rows share a number.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"))
    odd = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1 OR doc_id IS NULL")
    if dict(rows.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint") and odd.isEmpty():
        # The filter drops nothing. It makes the two joins below read the same plan, so that Spark shuffles texts once for both.
        return rows.select(F.col("doc_id").cast("long").alias("doc"), "text").where("doc IS NOT NULL"), False
    marked = rows.withColumn("hash", F.xxhash64("text"))
    ids = marked.select(F.col("doc_id").alias("id_"), F.col("hash").alias("hash_")).distinct()
    ordered = ids.repartitionByRange(F.col("id_").asc_nulls_first(), "hash_").sortWithinPartitions(F.col("id_").asc_nulls_first(), "hash_")
    numbers = stage(ordered.withColumn("doc", F.monotonically_increasing_id()))
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("hash") == F.col("hash_"))
    return marked.join(numbers, same).select("doc", "doc_id", "text"), True


def repeated_spans(numbered: DataFrame) -> DataFrame:
    """(doc, start, number): runs of string starts in ``numbered`` (doc, text) whose string also starts earlier.

    1. Every text is cut into fragments, runs of starts that share an anchor. 2. Rows without text go to their key: copies
    of a fragment are settled there, fragments without partner dropped. 3. Only fragments that differ under one key
    fetch their text, and 4. shards of these are sorted by suffix.
    """
    show_package_to_workers()
    sifted = stage(fragments(numbered).repartition("key").sortWithinPartitions("key", "mark", "doc", "start").mapInArrow(sift, SPANS))
    wanted = sifted.where("key IS NOT NULL").groupBy(F.col("doc").alias("wanted")).agg(F.collect_list(F.struct("start", "number", "key")).alias("pieces"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, pieces in zip(batch.column("doc").to_pylist(), texts(batch.column("text")), batch.column("pieces").to_pylist()):
                found = [(p["key"], doc, p["start"], text[p["start"] : p["start"] + p["number"] + LENGTH - 1]) for p in pieces]
                yield pa.RecordBatch.from_pylist([dict(zip(("key", "doc", "start", "bytes"), row)) for row in found], schema=ARROW_PARTS)

    texted = numbered.join(wanted, F.col("doc") == F.col("wanted")).select("doc", "text", "pieces").mapInArrow(fetch, PARTS)
    sorted_spans = texted.repartition("key").sortWithinPartitions("key", "doc", "start").mapInArrow(sort_shards, SPANS)
    settled = sifted.where("key IS NULL")
    return settled.unionByName(sorted_spans).select("doc", "start", "number")


def cut_out(text: bytes, spans: list[dict]) -> tuple[list[tuple[int, int]], bytes]:
    """(maximal removed byte ranges, remaining bytes) of a text with runs of repeated starts."""
    ranges: list[tuple[int, int]] = []
    for start, end in sorted((span["start"], span["start"] + span["number"] - 1 + LENGTH) for span in spans):
        if ranges and start <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(end, ranges[-1][1]))
        else:
            ranges.append((start, end))
    at, kept = 0, []
    for start, end in ranges:
        kept.append(text[at:start])
        at = end
    kept.append(text[at:])
    return ranges, b"".join(kept)


RESULT = "struct<n_bytes:long,n_removed:long,removed:array<struct<start:long,end:long>>,kept:binary>"
ARROW_RESULT = pa.struct([
    ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
    ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()),
])
DIGEST = "struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string>"
ARROW_DIGEST = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept), one row per row of ``docs``; with ``digest`` counts and a SHA-256 instead.

    A byte goes if a string of LENGTH bytes covers it that also starts earlier, in a smaller id or further up in the same
    text; strings never cross texts and are judged on the input. ``removed`` lists the maximal byte ranges, ``kept`` is what is left,
    which need not be whole UTF-8. A null text is empty; shorter texts lose nothing. If ids repeat or are null, null comes
    first and rows with one id are ordered by a hash of their text; rows equal in both are one text and get the same result.
    Other columns are not read; an empty table gives an empty result.
    """
    numbered, repeats = numbered_docs(docs, id_column, text_column)
    spans = repeated_spans(numbered.dropDuplicates(["doc"]) if repeats else numbered)
    grouped = spans.groupBy(F.col("doc").alias("span_doc")).agg(F.collect_list(F.struct("start", "number")).alias("spans"))
    joined = numbered.join(grouped, F.col("doc") == F.col("span_doc"), "left")

    def whole(text: bytes, found: list | None):
        ranges, kept = cut_out(text, found or [])
        gone = sum(end - start for start, end in ranges)
        if digest:
            return len(text), gone, len(ranges), hashlib.sha256(kept).hexdigest()
        return len(text), gone, ranges, kept

    kind, arrow = (DIGEST, ARROW_DIGEST) if digest else (RESULT, ARROW_RESULT)

    def apply(text: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([whole(value, runs) for value, runs in zip(texts(text), found.to_pylist())], arrow)

    kept_id = F.col("doc_id") if repeats else F.col("doc").cast(docs.schema[id_column].dataType).alias("doc_id")
    return joined.select(kept_id, arrow_function(apply, kind)("text", "spans").alias("r")).select("doc_id", "r.*")
