"""Centroid clustering: nearest centroids by the equal-average equal-variance search, in exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyload.llm.common import show_package_to_workers
from skyload.operators.staging import stage

SIZE, SCALE, CLUSTERS, ROUNDS = 64, 1024, 8, 10
#: The largest distance that a long can hold; inertia stops there.
MOST = 2**63 - 1
#: More than rounding can add to a difference of means or of deviations, so that no bound ever exceeds the distance.
SLACK = 1e-5


def limit(size: int) -> int:
    """The largest component for which every squared distance of two vectors fits in a long."""
    return int((MOST / size) ** 0.5 / 2) - 1


def whole_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors of exactly ``size`` components, none null or non-finite, each component ``floor(scale * x)``.

    Components beyond :func:`limit` (189,812,530 for 64 components, x above 185,000) stop there, as distances of larger ones need not fit in a long.
    """
    most = limit(size)
    x = F.col(vector_column).cast("array<double>")

    def finite(e: Column) -> Column:
        return e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))

    def whole(e: Column) -> Column:
        return F.floor(F.greatest(F.least(e * F.lit(float(scale)), F.lit(float(most))), F.lit(float(-most)))).cast("int")

    kept = vectors.select(F.col(id_column).alias("vec_id"), x.alias("x")).where((F.size("x") == size) & F.forall("x", finite))
    return kept.select("vec_id", F.transform("x", whole).alias("v"))


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the least SHA-256 of ``seed:vec_id``, in ascending order of the hash; ties by the components."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    chosen = rows.select(F.sha2(name, 256).alias("hash"), "v").orderBy("hash", "v").limit(clusters).collect()
    return [list(row["v"]) for row in chosen]


class Centroids:
    """Centroids in ascending order of their component mean, with their deviations from it."""

    def __init__(self, centroids: list[list[int]]) -> None:
        rows = np.array(centroids, np.int64)
        means, deviations = moments(rows)
        order = np.lexsort((np.arange(len(rows)), means))
        self.numbers, self.rows, self.means, self.deviations = order, rows[order], means[order], deviations[order]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each vector; of equally near ones the smaller number.

        From the place of a vector's own mean the centroids are visited outward, the one with the closer mean first. With
        ``g`` the difference of the means, ``d`` that of the deviations and ``n`` components, the squared
        distance is at least ``n g^2`` and at least ``n g^2 + d^2``: beyond the first bound the scan ends, as means only lie further
        off from there, beyond the second a centroid is passed over. Bounds are rounded down, and a centroid whose bound
        equals the best distance is still measured, so the integers alone decide. All vectors of a batch
        take their steps together; the arrays hold those whose scan goes on.
        """
        size, total = vectors.shape[1], len(self.rows)
        means, deviations = moments(vectors)
        best = np.full(len(vectors), MOST, np.int64)
        number = np.full(len(vectors), -1, np.int64)
        high = np.searchsorted(self.means, means)
        low = high - 1
        going = np.arange(len(vectors))
        while len(going):
            below = np.where(low[going] >= 0, np.abs(means[going] - self.means[np.maximum(low[going], 0)]), np.inf)
            above = np.where(high[going] < total, np.abs(self.means[np.minimum(high[going], total - 1)] - means[going]), np.inf)
            gap = np.minimum(below, above)
            bound = size * np.maximum(gap - SLACK, 0) ** 2
            stay = (number[going] < 0) | (bound <= best[going])
            stay &= np.isfinite(gap)
            going, below, above, bound = going[stay], below[stay], above[stay], bound[stay]
            down = below <= above
            place = np.where(down, low[going], high[going])
            low[going] -= down
            high[going] += ~down
            apart = np.abs(deviations[going] - self.deviations[place])
            near = (number[going] < 0) | (bound + np.maximum(apart - SLACK, 0) ** 2 <= best[going])
            seen, place = going[near], place[near]
            difference = vectors[seen] - self.rows[place]
            distance = np.einsum("ij,ij->i", difference, difference)
            named = self.numbers[place]
            closer = (number[seen] < 0) | (distance < best[seen]) | ((distance == best[seen]) & (named < number[seen]))
            best[seen[closer]], number[seen[closer]] = distance[closer], named[closer]
        return number, best


def moments(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component mean of each row and the length of its deviation from that mean."""
    means = rows.sum(axis=1) / rows.shape[1]
    return means, np.sqrt(((rows - means[:, None]) ** 2).sum(axis=1))


def matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def moved(rows: DataFrame, centroids: list[list[int]], size: int) -> list[list[int]]:
    """One round: each centroid becomes the floor of the mean of its vectors; one without vectors stays.

    Every task sends one row of sums per centroid that it met; they are added in Spark, per component.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Centroids(centroids)
        counts, totals = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), size), np.int64)
        for batch in batches:
            vectors = matrix(batch, size)
            number, _ = search.nearest(vectors)
            counts += np.bincount(number, minlength=len(centroids))
            for cluster in np.unique(number):
                totals[cluster] += vectors[number == cluster].sum(axis=0)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met, pa.int32()), pa.array(counts[met]), pa.array(totals[met].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "totals"]
        )

    show_package_to_workers()
    partial = rows.select("v").mapInArrow(sums, "cluster int, n long, totals array<long>")
    total = partial.select("cluster", "n", F.posexplode("totals").alias("at", "part")).groupBy("cluster", "at").agg(
        F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")
    )
    new = [list(centroid) for centroid in centroids]
    for row in total.collect():  # clusters times components
        new[row["cluster"]][row["at"]] = int(row["total"]) // int(row["n"])
    return new


def cluster_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = 3,
    size: int = SIZE,
    scale: int = SCALE,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per whole vector.

    Lloyd's rounds over integers: see :func:`whole_vectors`, :func:`first_centroids`, :func:`moved`. The integer vectors are written
    once and read once per round, a scan without a shuffle of vectors, so it does not matter how many belong to one
    cluster. The driver holds the centroids, ``clusters`` times ``size`` numbers. Vectors that are null, of another length or
    not finite have no row. Repeated rows and ids are kept as they are and count as often as they occur; a null id is hashed as
    the word null. With fewer vectors than clusters each starts its own; an empty table gives no row. Inertia beyond a long stops at its
    largest value. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = stage(whole_vectors(vectors, id_column, vector_column, size, scale))
    centroids = first_centroids(rows, clusters, seed)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if not centroids:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(rows, centroids, size)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Centroids(centroids)
        for batch in batches:
            number, distance = search.nearest(matrix(batch, size))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = stage(rows.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"))
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()
    inertia = {row["cluster"]: int(row["inertia"]) for row in sums}
    whole = min(sum(inertia.values()), MOST)
    digest = [hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest() for centroid in centroids]
    facts = [(number, min(total, MOST), whole, digest[number]) for number, total in inertia.items()]
    # One row per centroid: their number is a parameter.
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
