"""Centroid clustering of integer vectors with n-simplex projection.

The distances of a vector to ``n`` pivots fix a simplex: the pivots are its base,
the vector is its apex.  Set into a space of ``n`` dimensions, the base in the
first ``n - 1`` of them, the apex gets coordinates, the last of which is its
height over the base.  For two apexes the Euclidean distance is a lower bound of
the true distance, and with the height of one turned around an upper bound.

The pivots are the first centroids (those that span a proper simplex), so the
distances to them are measured once, before the first round, and the coordinates
are written next to the vectors.  Every round projects the few centroids, bounds
all distances from the coordinates alone, drops each centroid whose lower bound
is over the smallest upper bound of a vector, and compares the rest in exact
integers.  Bounds are widened by ``SLACK`` times the squares they are made from,
far more than rounding can do, so the result is that of comparing all.

Sums of a round are made in the tasks, at most one row per task, centroid and
component, and added up by Spark; the driver holds the centroids only.

Edge cases: vectors that are null, of another size or hold null or non-finite
components are not in the result; fewer vectors than ``k`` give fewer centroids;
equal vectors may start several centroids, of which the smaller number then
takes all; a null ``vec_id`` hashes last, equal hashes go by the vector; repeated
rows count as often as they occur; an empty table gives no rows; other columns
are ignored.  Components beyond ``LIMIT`` in size end the job with an error, as
their squared distances do not fit into a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

SIZE, SCALE = 64, 64
CENTROIDS, ROUNDS, SEED = 16, 3, 1
SLACK = 1e-6
#: Share of the longest base edge that a pivot must rise over the pivots before it.
LEAST_HEIGHT = 1e-2
LIMIT = 1 << 27
ROWS_AT_ONCE = 8192


class Simplex:
    """Base of pivots, and apexes over it."""

    def __init__(self, candidates: np.ndarray):
        """Takes of the integer ``candidates`` those that stand clear of the ones before."""
        points = candidates.astype(np.float64)
        edges = points[1:] - points[0]
        longest = np.sqrt((edges ** 2).sum(axis=1).max(initial=0.0))
        chosen, base = [0], np.zeros((0, 0))
        for at, edge in enumerate(edges, 1):
            # The pivot's own coordinates over the base so far: a row of a lower triangle.
            row = np.linalg.solve(base, edges[np.array(chosen[1:], int) - 1] @ edge) if len(base) else np.zeros(0)
            height = edge @ edge - row @ row
            if height > (LEAST_HEIGHT * longest) ** 2:
                base = np.block([[base, np.zeros((len(base), 1))], [row[None], np.array([[np.sqrt(height)]])]])
                chosen.append(at)
        self.pivots = candidates[chosen]
        self.base = base

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances to the pivots, exact."""
        return np.stack([squared(vectors, pivot) for pivot in self.pivots], axis=1)

    def apexes(self, distances: np.ndarray) -> np.ndarray:
        """Coordinates from squared distances to the pivots; the last one is the height."""
        first = distances[:, 0].astype(np.float64)
        if not len(self.base):
            return np.sqrt(first)[:, None]
        edges = (self.base ** 2).sum(axis=1)
        # <x - p0, p - p0> from three distances.
        products = (first[:, None] + edges - distances[:, 1:]) / 2
        flat = np.linalg.solve(self.base, products.T).T
        return np.concatenate([flat, np.sqrt((first - (flat ** 2).sum(axis=1)).clip(0))[:, None]], axis=1)


def squared(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    gap = vectors - point
    return np.einsum("ij,ij->i", gap, gap)


def bounds(apexes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all squared distances between the owners of two sets of apexes."""
    own, far = (apexes ** 2).sum(axis=1)[:, None], (others ** 2).sum(axis=1)[None]
    lower = own + far - 2 * apexes @ others.T
    upper = lower + 4 * apexes[:, -1:] * others[:, -1][None]
    slack = SLACK * (own + far) + 1.0
    return lower - slack, upper + slack


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller), its squared distance, and how many centroids were compared exactly."""
    lower, upper = bounds(apexes, simplex.apexes(simplex.distances(centroids)))
    open_ = lower <= upper.min(axis=1, keepdims=True)
    best = np.full(len(vectors), -1, np.int32)
    distance = np.full(len(vectors), np.iinfo(np.int64).max)
    for number, centroid in enumerate(centroids):
        rows = np.flatnonzero(open_[:, number])
        found = squared(vectors[rows], centroid)
        nearer = found < distance[rows]
        best[rows[nearer]], distance[rows[nearer]] = number, found[nearer]
    return best, distance, open_.sum(axis=1)


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A column of lists of one length."""
    values = np.asarray(column.flatten(), kind)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(low, ROWS_AT_ONCE)


def integer_vectors(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``vec_id, vector``: the usable vectors as integers ``floor(scale * x)``."""
    whole = F.col("embedding").cast("array<double>")
    usable = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(whole, lambda x: F.when(
        F.abs(x) * scale <= LIMIT, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is too large for exact distances"))))
    return vectors.where(whole.isNotNull() & (F.size(whole) == size) & usable) \
        .select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled.cast("array<bigint>").alias("vector"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(hashed.asc_nulls_last(), "vector").limit(k).select("vector").collect()
    return np.array([row["vector"] for row in rows], np.int64)


def project(vectors: DataFrame, simplex: Simplex) -> DataFrame:
    """``vec_id, vector, apex``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts(batches):
            apexes = simplex.apexes(simplex.distances(matrix(rows.column("vector"), np.int64)))
            offsets = pa.array(np.arange(len(apexes) + 1) * apexes.shape[1], pa.int32())
            yield pa.RecordBatch.from_pydict({
                "vec_id": rows.column("vec_id"), "vector": rows.column("vector"),
                "apex": pa.ListArray.from_arrays(offsets, pa.array(apexes.ravel()))})

    return vectors.mapInArrow(run, "vec_id bigint, vector array<bigint>, apex array<double>")


def moved(projected: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """The centroids after one round: exact floors of the means, unmoved where nothing is assigned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for rows in parts(batches):
            vectors = matrix(rows.column("vector"), np.int64)
            best, _, _ = nearest(vectors, matrix(rows.column("apex"), np.float64), centroids, simplex)
            counts += np.bincount(best, minlength=len(centroids))
            np.add.at(sums, best, vectors)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "cluster": np.repeat(full, sums.shape[1]), "component": np.tile(np.arange(sums.shape[1]), len(full)),
            "total": sums[full].ravel(), "members": np.repeat(counts[full], sums.shape[1])})

    # As many rows as all centroids have components.
    rows = projected.select("vector", "apex").mapInArrow(run, "cluster bigint, component bigint, total bigint, members bigint") \
        .groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("members").alias("members")).collect()
    result = centroids.copy()
    for row in rows:
        result[row["cluster"], row["component"]] = row["total"] // row["members"]
    return result


def assigned(projected: DataFrame, centroids: np.ndarray, simplex: Simplex) -> DataFrame:
    """``vec_id, cluster, distance, n_compared``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts(batches):
            best, distance, compared = nearest(
                matrix(rows.column("vector"), np.int64), matrix(rows.column("apex"), np.float64), centroids, simplex)
            yield pa.RecordBatch.from_pydict({
                "vec_id": rows.column("vec_id"), "cluster": pa.array(best), "distance": distance,
                "n_compared": compared.astype(np.int32)})

    return projected.mapInArrow(run, "vec_id bigint, cluster int, distance bigint, n_compared int")


def fit(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray, Simplex]:
    """The vectors with their apexes, the centroids after all rounds, and the simplex, for ``vectors(vec_id, vector)``."""
    centroids = first_centroids(vectors, k, seed)
    simplex = Simplex(centroids)
    projected = stored(project(vectors, simplex), "apexes")
    for _ in range(rounds):
        centroids = moved(projected, centroids, simplex)
    return projected, centroids, simplex


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED,
             size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_compared`` for ``vectors(vec_id, embedding)``."""
    spark = vectors.sparkSession
    whole = stored(integer_vectors(vectors, size, scale), "integer-vectors")
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_compared"]
    if whole.isEmpty():
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, "
                                         "inertia bigint, centroid_sha256 string, n_compared int")
    projected, centroids, simplex = fit(whole, k, rounds, seed)
    rows = stored(assigned(projected, centroids, simplex), "assigned")
    # One row per centroid.
    totals = {row["cluster"]: row["total"] for row in rows.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest() for centroid in centroids]
    facts = spark.createDataFrame(
        [(number, total, sum(totals.values()), hashes[number]) for number, total in totals.items()],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(columns)
