"""SimHash near-duplicates: fingerprints, a grid of segment popcounts as candidate search, exact bits, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyload.llm.common import per_text
from skyload.operators.staging import stage

SEED = 42
#: Segments of 3 bits, the last of 1: the embedding of a fingerprint counts the set bits of each, in two bits of a number.
#: Shorter segments tell more fingerprints apart: two random ones are within distance 2 once in 100 million pairs.
SEGMENT_BITS = 3
STARTS = range(0, 64, SEGMENT_BITS)
#: So many hash values are taken apart into bits at a time.
CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64 majority bits of the XXH64 values of all word shingles, as a signed number; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    hash_of = xxhash.xxh64_intdigest
    number = len(words) - size + 1
    values = np.fromiter((hash_of(joined[a:b], SEED) for a, b in zip(starts[:number].tolist(), ends[size - 1 :].tolist())), np.uint64, number)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, number, CHUNK):
        block = values[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * set_bits > number, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; null and white texts have fingerprint 0."""
    return docs.select(F.col(id_column).alias("doc_id"), per_text(lambda text: fingerprint(text, shingle), "long", pa.int64())(text_column).alias("fp"))


def popcounts(fp: Column) -> list[Column]:
    mask = (1 << SEGMENT_BITS) - 1
    return [F.bit_count(F.shiftrightunsigned(fp, start).bitwiseAND(F.lit(mask))).cast("long") for start in STARTS]


def cells(fp: Column) -> Column:
    """The grid cells within Manhattan distance 1 of the embedding of a fingerprint, as packed numbers.

    Embeddings at a distance of 2 or less share such a cell, and no others do.
    """
    counts = popcounts(fp)
    home = counts[0]
    for i, count in enumerate(counts[1:], 1):
        home = home.bitwiseOR(F.shiftleft(count, 2 * i))
    around = [home]
    for i, (start, count) in enumerate(zip(STARTS, counts)):
        step = F.lit(1 << (2 * i))
        around += [F.when(count < min(SEGMENT_BITS, 64 - start), home + step), F.when(count > 0, home - step)]
    return F.array_compact(F.array(*around))


def dealt(df: DataFrame, column: str) -> DataFrame:
    """The rows over all shuffle partitions: many rows are made of each next, which Spark cannot know when it sizes tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(column))


def near_values(fp: Column) -> Column:
    """The 64-bit numbers at one bit or none: two fingerprints share one exactly if they differ in two bits at most."""
    flips = [(1 << i) if i < 63 else -(1 << 63) for i in range(64)]
    return F.array(fp, *[fp.bitwiseXOR(F.lit(flip)) for flip in flips])


def candidates(distinct: DataFrame) -> DataFrame:
    """(fp): the fingerprints that meet another one in a grid cell, hence all with one at two bits or fewer.

    Each bit changes one count by one, so the Manhattan distance of two embeddings is a lower bound of the
    distance in bits. The range join of radius 2 is an equality on shared cells of radius 1; as only the
    question matters whether a cell has a second fingerprint, pairs are never listed, however many meet.
    """
    placed = dealt(distinct, "fp").select("fp", F.explode(cells(F.col("fp"))).alias("cell"))
    shared = placed.groupBy("cell").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("cell")
    # Spark sizes an exploded table like the table before, so it is told not to broadcast one.
    return placed.hint("merge").join(shared, "cell", "left_semi").select("fp").distinct()


def links(found: DataFrame, distance: int) -> DataFrame:
    """(a, b) with a > b, from which all links at ``distance`` bits or fewer follow; each row holds exactly.

    At two bits, fingerprints that share a number one bit away from both (or one of them) are linked with each other,
    so each gets a link to the smallest of them: a star instead of all pairs. At one bit a fingerprint has 64 neighbours.
    """
    if distance not in (1, 2):
        raise ValueError("the distance must be 1 or 2 bits; at 0 only equal fingerprints are linked, which needs no search")
    near = dealt(found, "fp").select(F.col("fp").alias("a"), F.explode(near_values(F.col("fp"))).alias("value")).hint("merge")
    if distance == 1:
        return near.join(found.select(F.col("fp").alias("value")), "value").where("a > value").select("a", F.col("value").alias("b"))
    hubs = near.groupBy("value").agg(F.min("a").alias("b"), F.max("a").alias("high")).where("b <> high").select("value", "b")
    return near.join(hubs, "value").where("a <> b").select("a", "b").distinct()


def followed(parents: DataFrame) -> DataFrame:
    """(node, up) with ``up`` replaced by the root it leads to; every jump halves the way, pointers never rise."""
    while True:
        onward = parents.select(F.col("node").alias("up"), F.col("up").alias("next"))
        jumped = stage(parents.join(onward, "up").select("node", F.col("up").alias("old"), F.col("next").alias("up")))
        parents = jumped.select("node", "up")
        if jumped.where("old <> up").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes with an edge (a, b), root being the smallest node that can be reached.

    Each round points every node at its smallest neighbour if that is smaller, follows the pointers to their
    roots, and keeps the edges between different roots; every root with a smaller neighbour is gone after it, so few
    rounds are needed. All tables of a round are written to the shared folder.
    """
    current, mapping = stage(edges), None
    while mapping is None or not current.isEmpty():
        a, b = F.col("a"), F.col("b")
        both = current.select(a.alias("node"), b.alias("other")).unionByName(current.select(b.alias("node"), a.alias("other")))
        roots = followed(stage(both.groupBy("node").agg(F.min("other").alias("up")).withColumn("up", F.least("node", "up"))))
        if mapping is None:
            mapping = roots.select("node", F.col("up").alias("root"))
        else:
            moved = roots.select(F.col("node").alias("root"), "up")
            mapping = stage(mapping.join(moved, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        ends = current.join(roots.select(F.col("node").alias("a"), F.col("up").alias("root_a")), "a")
        ends = ends.join(roots.select(F.col("node").alias("b"), F.col("up").alias("root_b")), "b").where("root_a <> root_b")
        current = stage(ends.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
    return mapping


def fingerprint_classes(prints: DataFrame, distance: int) -> DataFrame:
    """(fp, root) of the fingerprints with a link; ``prints`` is a table with a column fp."""
    found = stage(candidates(prints.select("fp").distinct()))
    return components(links(found, distance)).select(F.col("node").alias("fp"), "root")


def near_classes(
    docs: DataFrame, shingle: int = 3, distance: int = 2, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, fp, component_id, representative), one row per row of ``docs``.

    Documents are linked if their fingerprints differ in at most ``distance`` bits, 1 or 2 (others raise ValueError); component_id is the smallest doc_id
    that can be reached. Copies share a fingerprint, and only distinct fingerprints are searched, so a group of copies
    costs one row. Documents without words have fingerprint 0 and are linked like others. Null ids come last; a component
    of null ids only has a null id. Repeated rows get the same component; ``representative`` is true for rows with its id.
    """
    prints = stage(fingerprints(docs, shingle, id_column, text_column))
    roots = fingerprint_classes(prints, distance).select("fp", "root")
    ids = prints.groupBy("fp").agg(F.min("doc_id").alias("id"))
    rooted = ids.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "id")
    first = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = rooted.join(first, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", "fp", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("representative")
    )


def drop_near_copies(docs: DataFrame, shingle: int = 3, distance: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of ``docs`` per component of linked fingerprints, with all columns: the one with the smallest id, null ids last.

    Components are told apart by the smallest fingerprint in them, never by an id, so rows that share an id (or have none) but lie
    in different components all stay. Of several rows with the smallest id of a component the one with the smallest SHA-256 of
    the text stays; if a table holds a kept id and text several times, one of these rows does.
    """
    text_sha256 = F.unhex(F.sha2(F.coalesce(F.col(text_column), F.lit("")), 256))
    fp = per_text(lambda text: fingerprint(text, shingle), "long", pa.int64())(text_column)
    prints = stage(docs.select(F.col(id_column).alias("doc_id"), text_sha256.alias("text_sha256"), fp.alias("fp")))
    roots = fingerprint_classes(prints, distance).select("fp", "root")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_sha256", "times")
    texts = prints.groupBy("fp", "doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("times"))
    first = texts.groupBy("fp").agg(F.min(rank).alias("best")).join(roots, "fp", "left")
    best = first.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best"))
    kept = stage(best.select(F.col("best.doc_id").alias("keep_id"), F.col("best.text_sha256").alias("keep_sha256"), F.col("best.times").alias("times")))
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"), F.col(id_column).alias("doc_id"), text_sha256.alias("text_sha256")
    )
    found = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_sha256") == F.col("keep_sha256")))
    if kept.where("times > 1").isEmpty():
        return found.select("row.*")
    one = F.min_by("row", F.xxhash64(F.to_json("row")))
    return found.groupBy("keep_id", "keep_sha256").agg(one.alias("row")).select("row.*")
