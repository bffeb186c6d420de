"""Prefix trie of conversations: adaptive radix trees over fixed-width turn ids, built per batch and merged by node."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyload.llm.common import arrow_function, show_package_to_workers
from skyload.llm.radix_tree import Tree
from skyload.operators.staging import stage

#: Bytes of a turn id, turns in a piece of a conversation, turns of a batch of pieces that build trees, member ids in a chunk of a list.
WIDTH, PIECE, BATCH, CHUNK = 16, 64, 100_000, 4096
#: A conversation borrows its first turns from the one at the start of its family, up to HEAD of them.
FAMILY, HEAD = 20, 4

WORDS = r"[^\x20\x09-\x0D]+"
PIECES = "conv_id long, task int, nth long, n int, ids binary, words array<int>"
NODES = "a long, b long, up_a long, up_b long, depth long, conv_id long, n_convs long, n_leaves long, saved_tokens long, deeper boolean"
FIELDS = ("a", "b", "up_a", "up_b", "depth", "conv_id", "n_convs", "n_leaves", "saved_tokens", "deeper")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, id, words): a turn's id is the MD5 of its role, with the role's length ahead, and its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.unhex(F.md5(content.cast("binary"))).alias("id"),
        F.regexp_count(text, F.lit(WORDS)).cast("int").alias("words"),
    )


def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of conversation and turn as pieces of up to ``PIECE`` turns; ``task`` and ``nth`` keep the order."""
    task, nth, current, ids, words = TaskContext.get().partitionId(), 0, None, [], []
    rows: list[tuple] = []
    for batch in batches:
        for conv_id, key, count in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "id", "words"))):
            if ids and (conv_id != current or len(ids) == PIECE):
                rows.append((current, task, nth, len(ids), b"".join(ids), words))
                nth, ids, words = nth + 1, [], []
            current = conv_id
            ids.append(key)
            words.append(count)
        yield as_batch(rows, PIECES_ARROW)
        rows = []
    if ids:
        yield as_batch([(current, task, nth, len(ids), b"".join(ids), words)], PIECES_ARROW)


PIECES_ARROW = pa.schema([("conv_id", pa.int64()), ("task", pa.int32()), ("nth", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("words", pa.list_(pa.int32()))])
NODES_ARROW = pa.schema([(name, pa.bool_() if name == "deeper" else pa.int64()) for name in FIELDS])


def as_batch(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(columns, schema)], schema=schema)


def pieces_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, task, nth, n, ids, words) of all conversations, none of whose sizes matters.

    Narrow rows are written once and sorted by ranges of (conv_id, turn, id), so that a very long
    conversation spans several tasks; its pieces are numbered by task and place.
    """
    order = ["conv_id", "turn", "id"]
    show_package_to_workers()
    return stage(stage(turn_rows(conversations)).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut_pieces, PIECES))


def mixed_in(conversations: DataFrame) -> DataFrame:
    """(conv_id, family, at, ids, words, last): the pieces of the rebuilt conversations.

    A conversation c takes the first h turns of conversation c - c % 20, h = crc32(c) % 4, before its own turns after the
    first h. The head joins the piece that holds its turn h, or its last turn if it has no more than h.
    """
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    inside = Window.partitionBy("family", "conv_id").orderBy("task", "nth")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("family", "conv_id")
    pieces = (
        pieces_of(conversations)
        .withColumn("family", family)
        .repartition("family")
        .withColumns({"start": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(whole)})
    )
    parts = F.array_sort(F.collect_list(F.struct("start", "ids", "words")))
    head = (
        pieces.where((F.col("conv_id") == F.col("family")) & (F.col("start") < HEAD - 1))
        .groupBy("family")
        .agg(parts.alias("parts"))  # at most three pieces
        .select(
            "family",
            F.aggregate("parts", F.lit(b""), lambda all, part: F.concat(all, part["ids"])).alias("head_ids"),
            F.flatten(F.transform("parts", lambda part: part["words"])).alias("head_words"),
        )
    )
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    rows = pieces.join(head, "family", "left").withColumn("h", h)
    rows = rows.withColumns(
        {
            "borrowed": F.least("h", F.coalesce(F.size("head_words"), F.lit(0))),
            "turn_h": F.least(F.col("h"), F.col("total") - 1),
            "cut": F.greatest(F.lit(0), F.least(F.col("n"), F.col("h") - F.col("start"))).cast("int"),
        }
    ).where(F.col("start") + F.col("n") > F.col("turn_h"))
    first = F.col("start") <= F.col("turn_h")
    own_ids = F.expr(f"substring(ids, {WIDTH} * cut + 1)")
    own_words = F.slice("words", F.col("cut") + 1, F.col("n") - F.col("cut"))
    return rows.select(
        "conv_id",
        "family",
        F.when(first, 0).otherwise(F.col("start") - F.col("h") + F.col("borrowed")).cast("long").alias("at"),
        F.when(first & (F.col("borrowed") > 0), F.concat(F.expr(f"substring(head_ids, 1, {WIDTH} * borrowed)"), own_ids)).otherwise(own_ids).alias("ids"),
        F.when(first & (F.col("borrowed") > 0), F.concat(F.slice("head_words", F.lit(1), F.col("borrowed").cast("int")), own_words)).otherwise(own_words).alias("words"),
        (F.col("start") + F.col("n") == F.col("total")).alias("last"),
    )


def sign(key: bytes, depth: int) -> int:
    """The number of a turn id at a depth; a prefix is named by the exclusive or of its turns' numbers."""
    return xxhash.xxh3_128_intdigest(key + depth.to_bytes(8, "big"))


def halves(number: int) -> tuple[int, int]:
    return ((number >> 64) ^ (1 << 63)) - (1 << 63), ((number & (2**64 - 1)) ^ (1 << 63)) - (1 << 63)


def joined(a: int, b: int) -> int:
    return (a % (1 << 64)) << 64 | b % (1 << 64)


def piece_signs(at: pa.Array, ids: pa.Array) -> pa.Array:
    found = []
    for depth, whole in zip(at.to_pylist(), ids.to_pylist()):
        number = 0
        for turn in range(len(whole) // WIDTH):
            number ^= sign(whole[turn * WIDTH : (turn + 1) * WIDTH], depth + turn + 1)
        found.append(dict(zip("ab", halves(number))))
    return pa.array(found, pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def members_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, ids, words, last, a, b, end_a, end_b): pieces with the names of the prefixes that they follow and end."""
    rows = mixed_in(conversations).withColumn("own", arrow_function(piece_signs, "struct<a:long,b:long>")("at", "ids"))
    inside = Window.partitionBy("family", "conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    for half in "ab":
        rows = rows.withColumn(half, F.coalesce(F.bit_xor(f"own.{half}").over(inside), F.lit(0)))
    ends = [F.col(half).bitwiseXOR(F.col(f"own.{half}")).alias(f"end_{half}") for half in "ab"]
    return stage(rows.select("conv_id", "at", "ids", "words", "last", "a", "b", *ends))


def tree_nodes(pieces: list[tuple]) -> Iterator[tuple]:
    """The trie nodes of some pieces, ``pieces`` being (conv_id, at, ids, words, last, a, b, shared, tail, leaf).

    One radix tree per starting place. Turn ids are 16 bytes wide, so a path may end inside one: only byte depths that are a multiple
    of 16 become nodes, also those inside a compressed path. Per node: members, leaves among their ends, and the words
    of turns from here on that lie in a member's ``shared`` first turns, ``tail`` being those in its later pieces.
    """
    trees: dict[tuple[int, int, int], Tree] = {}
    for piece in pieces:
        tree = trees.setdefault((piece[1], piece[5], piece[6]), Tree())
        tree.insert(piece[2], piece)
    stops: dict[int, dict[int, int]] = {}
    for piece in pieces:
        if piece[7] > 0:
            node = trees[piece[1], piece[5], piece[6]].reach(piece[2], piece[7] * WIDTH)
            marks = stops.setdefault(id(node), {})
            marks[piece[7]] = marks.get(piece[7], 0) + 1
    for (at, a, b), tree in trees.items():
        order = tree.downward()
        words: dict[int, list[int]] = {}
        for node, parent in order:
            name = joined(a, b) if parent is None else parent.kept[0][-1]
            names = [name]
            for turn in range(node.top // WIDTH, node.bottom // WIDTH):
                name ^= sign(node.key[turn * WIDTH : (turn + 1) * WIDTH], at + turn + 1)
                names.append(name)
            # names, least conversation, members, leaves, saved words, members whose shared turns go on, a deeper turn
            node.kept = [names, None, 0, 0, 0, 0, False]
        for node, parent in reversed(order):
            kept = node.kept
            for piece in node.values:
                kept[1] = piece[0] if kept[1] is None else min(kept[1], piece[0])
                kept[2] += 1
                kept[3] += piece[9]
                kept[4] += piece[8]
                kept[6] |= not piece[4]
                words[id(node)] = piece[3]
            names, conv_id, members, leaves, saved, live, deeper = kept
            counts, marks = words.get(id(node)), stops.get(id(node), {})
            for place in range(len(names) - 1, 0, -1):
                turn = node.top // WIDTH + place
                live += marks.get(turn, 0)
                saved += live * counts[turn - 1]
                yield (*halves(names[place]), *halves(names[place - 1]), at + turn, conv_id, members, leaves, saved, deeper)
                deeper = True
            if parent is None:
                if at == 0 and members:
                    yield (*halves(names[0]), None, None, 0, conv_id, members, leaves, saved, deeper)
                continue
            above = parent.kept
            above[1] = conv_id if above[1] is None else min(above[1], conv_id)
            above[2] += members
            above[3] += leaves
            above[4] += saved
            above[5] += live
            # A path may end inside a turn id; whether a turn follows is known at its last whole turn.
            above[6] |= deeper or node.bottom // WIDTH > node.top // WIDTH
            if counts is not None:
                words[id(parent)] = counts


def nodes_of(members: DataFrame) -> DataFrame:
    """Nodes of the batches' trees, to be merged by their names."""
    names = ("conv_id", "at", "ids", "words", "last", "a", "b", "shared", "tail", "leaf")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, turns = [], 0
        for batch in batches:
            for piece in zip(*(batch.column(name).to_pylist() for name in names)):
                pieces.append(piece)
                turns += 1 + len(piece[2]) // WIDTH
                if turns >= BATCH:
                    yield as_batch(tree_nodes(pieces), NODES_ARROW)
                    pieces, turns = [], 0
        if pieces:
            yield as_batch(tree_nodes(pieces), NODES_ARROW)

    show_package_to_workers()
    return members.select(*names).mapInArrow(build, NODES)


def end_digests(members: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): SHA-256 of the sorted ids of the conversations that end at a node.

    Ids are listed in chunks of one range of 4,096 ids, which no number of copies can exceed, as ids are distinct here; the chunks
    of a node are then hashed one after another as they come sorted from the shuffle, so no list of all is made.
    """
    ends = members.where("last").select(F.col("end_a").alias("a"), F.col("end_b").alias("b"), "conv_id")
    chunk = F.floor(F.col("conv_id") / CHUNK).alias("chunk")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = ends.groupBy("a", "b", chunk).agg(listed.alias("listed")).repartition("a", "b").sortWithinPartitions("a", "b", "chunk")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            rows = []
            for a, b, text in zip(*(batch.column(name).to_pylist() for name in ("a", "b", "listed"))):
                if (a, b) == key:
                    running.update(b",")
                else:
                    if key is not None:
                        rows.append((*key, running.hexdigest()))
                    key, running = (a, b), hashlib.sha256()
                running.update(text.encode())
            yield as_batch(rows, schema)
        if key is not None:
            yield as_batch([(*key, running.hexdigest())], schema)

    return chunks.mapInArrow(digest, "a long, b long, ends_sha256 string")


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row per trie node.

    Every batch of pieces gives its own trees, whose nodes are merged by name, so a first turn that opens a third of all
    conversations is one partial row per batch. Trees are built twice. The first time shows the least member
    of every node: a conversation is the least one from some depth on, and its turns before that are shared with a smaller
    one. The words that a subtree saves, its turns counted once less than they have members, are then the words of its
    members' shared turns, a sum over members that the second trees fold upwards; leaves likewise are least members
    that end at a childless node. Prefixes are named by 128 bits, the exclusive or of a hash of each turn and its depth, so a long
    conversation is handled in pieces of 64 turns.

    Null conv_ids are no conversation and are left out; null roles and texts are empty; null turns come first; equal turn numbers
    are ordered by the MD5 of role and text, and repeated rows are turns of their own. A conversation left without turns
    is a member of the root. An empty table has no node. Other columns are not read.
    """
    members = members_of(conversations)
    first = members.withColumns({"shared": F.lit(0), "tail": F.lit(0).cast("long"), "leaf": F.lit(0)})
    least = nodes_of(first).groupBy("a", "b", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("deeper").alias("deeper"))
    chains = least.groupBy("conv_id").agg(F.min("depth").alias("own_from"), F.max((~F.col("deeper")).cast("int")).alias("leaf"))

    size = F.size("words")
    # Turns of a piece before depth own_from, all if the conversation is nowhere the least.
    shared = F.when(F.col("own_from").isNull(), size).otherwise(F.greatest(F.lit(0), F.least(size, F.col("own_from") - 1 - F.col("at")))).cast("int")
    total = F.aggregate(F.slice("words", F.lit(1), F.col("shared")), F.lit(0).cast("long"), lambda sum, count: sum + count)
    later = Window.partitionBy("conv_id").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    second = (
        members.join(chains, "conv_id", "left")
        .withColumns({"shared": shared, "leaf": F.coalesce("leaf", F.lit(0))})
        .withColumn("tail", F.coalesce(F.sum(total).over(later), F.lit(0)))
    )
    sums = [F.sum(name).alias(name) for name in ("n_convs", "n_leaves", "saved_tokens")]
    nodes = stage(nodes_of(second).groupBy("a", "b", "up_a", "up_b", "depth").agg(F.min("conv_id").alias("conv_id"), *sums))
    named = ["a", "b"]
    children = nodes.where("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(parents, ["up_a", "up_b"], "left")
        .join(children, named, "left")
        .join(end_digests(members), named, "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
        )
    )
