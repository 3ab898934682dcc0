"""Equal rows as one place with their number, and the silhouette over places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.operators.graph import checkpointed

#: How many rows a place stands for.
ROWS = "_rows"
#: Places of a partition, and partitions at most.
PART_PLACES, PARTS = 10_000, 200
#: Partitions that are few: beyond them a partition may have more places, where a pass over them is short.
FEW = 16
#: Distances of places to clusters that are held at once.
STEP = 1_000_000


def parts_of(n: int, part_places: int = PART_PLACES) -> int:
    """Partitions for `n` places: PART_PLACES each up to FEW, then `part_places` each, PARTS at most."""
    few = min(FEW, -(-n // PART_PLACES))
    return max(1, min(PARTS, max(few, -(-n // part_places))))


def places(df: DataFrame, features: list[str], part_places: int = PART_PLACES) -> DataFrame:
    """(features, _rows): every place once, with its number of rows; rows with a null are left out.

    Work that passes over all rows many times passes over the places instead. They are dealt by their values and
    sorted, so that a draw with a seed is the same on every run and every cluster of machines.
    """
    own = checkpointed(df.dropna(subset=features).groupBy(*features).agg(F.count("*").cast("double").alias(ROWS)))
    return own.repartition(parts_of(own.count(), part_places), *features).sortWithinPartitions(*features)


def silhouette(made: DataFrame, features: list[str], cluster: str) -> float:
    """Mean silhouette of all rows by squared distances, from places with `cluster` and their number of rows; -1 for fewer than two clusters.

    The mean squared distance to a cluster follows from its rows, their sum and that of their squared lengths. Rows of
    one place are different rows: only the row itself is left out of its own cluster. A single row has 0.
    """
    norm = sum((F.col(f) * F.col(f) for f in features), F.lit(0.0))
    stats = made.groupBy(cluster).agg(F.sum(ROWS), F.sum(norm * F.col(ROWS)), *(F.sum(F.col(f) * F.col(ROWS)) for f in features)).orderBy(cluster).collect()  # a row for each cluster
    if len(stats) < 2:
        return -1.0
    shared = made.sparkSession.sparkContext.broadcast((np.array([r[0] for r in stats]), np.array([tuple(r)[1:] for r in stats], float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sums = shared.value
        n, squares, centres = sums[:, 0], sums[:, 1] / sums[:, 0], sums[:, 2:] / sums[:, :1]
        step = max(1, STEP // len(n))
        for b in batches:
            of = np.searchsorted(names, b.column(0).to_numpy(zero_copy_only=False))
            rows, *x = (b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 2 + len(features)))
            x = np.column_stack(x)
            total = 0.0
            for s in range(0, len(of), step):
                own, p = of[s : s + step], x[s : s + step]
                far = (p * p).sum(1)[:, None] + squares - 2 * p @ centres.T
                at = np.arange(len(own))
                within = far[at, own] * n[own] / np.maximum(n[own] - 1, 1)
                far[at, own] = np.inf
                across = far.min(1)
                most = np.maximum(within, across)
                value = np.where((n[own] > 1) & (most > 0), (across - within) / np.where(most > 0, most, 1), 0.0)
                total += float(value @ rows[s : s + step])
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.float64())], ["s"])

    asked = made.select(cluster, *(F.col(c).cast("double").alias(c) for c in (ROWS, *features)))
    return float(asked.mapInArrow(run, "s double").agg(F.sum("s")).first()[0] / sum(r[1] for r in stats))
