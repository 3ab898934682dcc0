"""Centroid clustering of integer vectors, with a tournament of bisectors.

For centroids a < b the points as near to a as to b are a hyperplane; with the
integer normal 2(b - a) and the threshold |b|^2 - |a|^2 one sign says which of
them is nearer. These are computed once for all pairs, and a vector's nearest
centroid is what k-1 sign tests leave over; a zero favours the smaller number.
Only the winner's distance is computed. All of it is integer arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components below it leave every sum of a test within 64 bits, up to 64 of them; others are compared as Python integers.
SMALL = 2**27


def finite(vector: Column) -> Column:
    """Whether a vector is there and all of its entries are numbers."""
    cells = vector.cast("array<double>")
    return F.coalesce(F.forall(cells, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def integers(cells: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python integers where 64 bits could be too few."""
    whole = np.floor(scale * cells)
    if whole.size and np.abs(whole).max() >= SMALL:
        return np.array([[int(x) for x in row] for row in whole], object)
    return whole.astype(np.int64)


@dataclass
class Bisectors:
    """normals[a, b] and limits[a, b] of the pairs of `centroids` (k x dims, integers)."""

    centroids: np.ndarray
    normals: np.ndarray
    limits: np.ndarray

    @classmethod
    def of(cls, centroids: list[list[int]]) -> Bisectors:
        c = np.array(centroids, object)
        if max((abs(x) for row in centroids for x in row), default=0) < SMALL and c.shape[-1] <= 64:
            c = c.astype(np.int64)
        length = (c * c).sum(1)
        return cls(c, 2 * (c[None] - c[:, None]), length[None] - length[:, None])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the nearest centroids of the rows of `x`, and the squared distances."""
        wide = object in (x.dtype, self.centroids.dtype)
        x = x.astype(object) if wide else x
        centroids, normals, limits = (m.astype(object) if wide else m for m in (self.centroids, self.normals, self.limits))
        best = np.zeros(len(x), np.int64)
        for b in range(1, len(centroids)):
            beyond = (normals[best, b] * x).sum(1) - limits[best, b] > 0
            best[beyond] = b
        apart = x - centroids[best]
        return best, (apart * apart).sum(1)


def _batches(batches: Iterator[pa.RecordBatch], dims: int, scale: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield b, integers(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dims), scale)


def _sums(kept: DataFrame, centroids: list[list[int]], scale: float) -> list[tuple[int, int, int, list[int]]]:
    """(cluster, vectors, summed distance, sums by component) of the clusters that have vectors.

    Every batch sends at most a row for each centroid, and the driver gets one row for each.
    """
    k, dims = len(centroids), len(centroids[0])
    shared = kept.sparkSession.sparkContext.broadcast(Bisectors.of(centroids))  # k x k x dims numbers
    exact = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _batches(batches, dims, scale):
            best, distance = shared.value.nearest(x)
            own = [(c, at) for c in range(k) if len(at := np.flatnonzero(best == c))]
            cells = [[Decimal(int(s)) for s in x[at].sum(0)] for _, at in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in own], pa.int32()), pa.array([len(at) for _, at in own], pa.int64()), pa.array([Decimal(int(distance[at].sum())) for _, at in own], exact), pa.array(cells, pa.list_(exact))], ["c", "n", "distance", "sums"]
            )

    parts = kept.select("v").mapInArrow(run, "c int, n long, distance decimal(38,0), sums array<decimal(38,0)>")
    rows = parts.groupBy("c").agg(F.sum("n"), F.sum("distance"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dims)))).collect()
    return [(r[0], r[1], int(r[2]), [int(s) for s in r[3]]) for r in rows]


@dataclass
class Clusters:
    """Final centroids, and the distance summed over each cluster."""

    centroids: list[list[int]]
    inertia: list[int]


def _kept(vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    cells = F.col(vector)
    whole = vectors.where((F.size(cells) == dims) & finite(cells))
    return whole.select(F.col(key).alias("id"), cells.cast("array<double>").alias("v"))


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 16, rounds: int = 3, scale: float = 64.0) -> Clusters:
    """Centroids of the vectors' integers floor(scale * x) after `rounds` rounds.

    Null vectors, those of another length than `dims` and those with an entry
    that is null or no number are left out. The first centroids are the k
    vectors with the least SHA-256 of `1:<key>` (a null key: of `1:`), equal
    ones by the vector itself; repeated rows are vectors of their own. With
    fewer than k vectors there are as many centroids as vectors, and without
    any there is none. A cluster without vectors keeps its centroid. Sums are
    exact up to 38 digits, beyond which the job fails.

    A round is one pass over the table where it lies; a row for each centroid
    comes to the driver.
    """
    kept = _kept(vectors, key, vector, dims)
    address = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(address, "id", "v").limit(k).select("v").collect()  # k rows
    centroids = [[int(x) for x in row] for row in integers(np.array([r.v for r in first]), scale)] if first else []
    if not centroids:
        return Clusters([], [])
    for _ in range(rounds):
        for c, n, _, sums in _sums(kept, centroids, scale):
            centroids[c] = [s // n for s in sums]
    inertia = [0] * len(centroids)
    for c, _, distance, _ in _sums(kept, centroids, scale):
        inertia[c] = distance
    return Clusters(centroids, inertia)


def assign(vectors: DataFrame, clusters: Clusters, key: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: float = 64.0) -> DataFrame:
    """(key, cluster, distance) of all vectors that `fit` would take, without a shuffle; a squared distance beyond a long fails."""
    kept = _kept(vectors, key, vector, dims)
    shared = vectors.sparkSession.sparkContext.broadcast(Bisectors.of(clusters.centroids) if clusters.centroids else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _batches(batches, dims, scale):
            if shared.value is None:
                return
            best, distance = shared.value.nearest(x)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(best, pa.int32()), pa.array(distance.tolist(), pa.int64())], ["id", "cluster", "distance"])

    found = kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, cluster int, distance long")
    return found.select(F.col("id").alias(key), "cluster", "distance")
