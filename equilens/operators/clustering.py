"""Clusters of rows by MLlib over standardised features, and what is said about them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equilens.operators import density
from equilens.operators.graph import checkpointed
from equilens.operators.places import ROWS, places, silhouette

#: Places of a partition where centres are fitted to many: a task of fewer takes longer to start than to run.
FIT_PLACES = 100_000
MODELS = {"kmeans": KMeans, "hierarchical": BisectingKMeans, "gmm": GaussianMixture}


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def candidates(df: DataFrame, features: list[str], kind: str, ks: tuple[int, ...] = (3, 4, 5, 6), seed: int = 42) -> list[tuple[int, float, object]]:
    """(k, silhouette, model) for each k; features are given standardised. -1 where only one cluster came out."""
    return [(k, c.silhouette, model) for k, c, model in _fitted(df, features, kind, ks, seed)]


def select(df: DataFrame, features: list[str], kind: str, ks: tuple[int, ...] = (3, 4, 5, 6)) -> DataFrame:
    """`df` with `cluster` of the candidate with the best silhouette (smaller k on ties)."""
    best = max(candidates(df, features, kind, ks), key=lambda c: (c[1], -c[0]))
    return best[2].transform(assembled(df, features)).select(*df.columns, "cluster")


def diagnostics(df: DataFrame, features: list[str], kinds: tuple[str, ...] = ("kmeans", "hierarchical")) -> DataFrame:
    rows = [(kind, k, round(s, 6)) for kind in kinds for k, s, _ in candidates(df, features, kind)]
    return df.sparkSession.createDataFrame(rows, "kind string, k int, silhouette double")  # a row per candidate


def log_likelihood(df: DataFrame, features: list[str], weights: np.ndarray, means: np.ndarray, covariances: np.ndarray, rows: str | None = None) -> float:
    """Of all rows without a null under a mixture of normal distributions; each task sends one sum per batch. `rows` is how often a row counts."""
    shared = df.sparkSession.sparkContext.broadcast((np.log(weights), means, [np.linalg.cholesky(c) for c in covariances]))  # k x features^2 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_weights, centres, roots = shared.value
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(features))])
            parts = []
            for w, m, root in zip(log_weights, centres, roots):
                z = np.linalg.solve(root, (x - m).T)
                parts.append(w - (z * z).sum(0) / 2 - np.log(np.diag(root)).sum() - len(features) * math.log(2 * math.pi) / 2)
            top = np.max(parts, axis=0)
            total = float((top + np.log(np.exp(np.array(parts) - top).sum(0))) @ b.column(len(features)).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.float64())], ["ll"])

    return df.select(*(F.col(f).cast("double").alias(f) for f in features), (F.col(rows) if rows else F.lit(1)).cast("double").alias("_rows")).dropna().mapInArrow(run, "ll double").agg(F.coalesce(F.sum("ll"), F.lit(0.0))).first()[0]


def free_parameters(k: int, features: int) -> int:
    """Of a mixture with full covariances: weights but one, means, and the triangles of the covariances."""
    return k - 1 + k * features + k * features * (features + 1) // 2


@dataclass
class Candidate:
    """A clustering that can be chosen; `rows` has the given columns and `cluster`."""

    method: str
    setting: str
    clusters: int
    smallest: int
    silhouette: float
    bic: float | None
    rows: DataFrame


def _measured(method: str, setting: str, made: DataFrame, features: list[str], rows: DataFrame, bic: float | None = None) -> Candidate:
    """A candidate by `made`, the clusters of all places."""
    sizes = [int(r[1]) for r in made.groupBy("cluster").agg(F.sum(ROWS)).collect()]  # a row for each cluster
    return Candidate(method, setting, len(sizes), min(sizes, default=0), silhouette(made, features, "cluster"), bic, rows)


def _fitted(df: DataFrame, features: list[str], kind: str, ks: tuple[int, ...], seed: int = 42) -> list[tuple[int, Candidate, object]]:
    """(k, candidate, model) for each k. Equal rows are one with their number.

    The places aren't persisted: a fit then persists its own vectors, which it passes over as they are; of a persisted
    table it would make them again in every pass.
    """
    data = assembled(checkpointed(places(df, features, FIT_PLACES)), features)
    found = []
    for k in ks:
        model = MODELS[kind](k=k, seed=seed, featuresCol="features", predictionCol="cluster", weightCol=ROWS).fit(data)
        found.append((k, _measured(kind, f"k={k}", model.transform(data), features, model.transform(assembled(df, features)).drop("features")), model))
    return found


def gmm_candidates(df: DataFrame, features: list[str], ks: tuple[int, ...] = (3, 4, 5, 6), seed: int = 42) -> list[Candidate]:
    """A mixture of normal distributions with full covariances for each k below the number of rows, with its BIC (less is better). Equal rows are one with their number."""
    data = assembled(places(df, features), features).persist()
    found = []
    try:
        n = int(data.agg(F.sum(ROWS)).first()[0] or 0)
        for k in (k for k in ks if k < n):
            model = GaussianMixture(k=k, seed=seed, maxIter=100, featuresCol="features", predictionCol="cluster", probabilityCol="_p", weightCol=ROWS).fit(data)
            shapes = model.gaussiansDF.collect()  # k rows
            ll = log_likelihood(data, features, np.maximum(model.weights, 1e-300), np.array([r["mean"].toArray() for r in shapes]), np.array([r["cov"].toArray() for r in shapes]), ROWS)
            bic = free_parameters(k, len(features)) * math.log(n) - 2 * ll
            found.append(_measured("gmm", f"k={k}", model.transform(data), features, model.transform(assembled(df, features)).drop("_p", "features"), bic))
    finally:
        data.unpersist()
    return found


class ClusteringError(ValueError):
    """No candidate passes the gates; `diagnostics` says why for each."""

    def __init__(self, message: str, diagnostics: DataFrame):
        super().__init__(message)
        self.diagnostics = diagnostics


def choose(
    df: DataFrame, features: list[str], methods: tuple[str, ...] = ("kmeans", "hierarchical", "gmm"), ks: tuple[int, ...] = (3, 4, 5, 6), min_clusters: int = 2, min_size: int = 1, min_share: float = 0.0,
    floor: float | None = None, key: str | None = None, eps: tuple[float, ...] = (0.3, 0.5, 0.7, 1.0), least: tuple[int, ...] = (5, 10, 15),
) -> tuple[DataFrame, DataFrame]:
    """(method, setting, clusters, smallest, silhouette, bic, reason, chosen) of all candidates, and `df` with `cluster` of the chosen one.

    Each method sends its best: the highest silhouette, of mixtures the least BIC; dbscan (which needs `key`) has its own
    gate for noise. One is valid with at least `min_clusters` clusters, all of at least `min_size` rows and of
    `min_share` of all rows. The valid one with the highest silhouette is chosen, the first on ties, and refused if that
    is below `floor`. A ClusteringError has the diagnostics. Features are given standardised; rows with a null are left out.
    """
    n = df.dropna(subset=features).count()
    bound = max(min_size, math.ceil(min_share * n))
    best: list[Candidate] = []
    listed: list[tuple[Candidate, str]] = []
    for method in methods:
        if method == "dbscan":
            grid, rows = density.dbscan_grid(df.dropna(subset=features), key, features, list(eps), list(least))
            made = [(r, _measured(method, f"eps={r.eps},least={r.least}", rows.groupBy(*features, "cluster").agg(F.count("*").cast("double").alias(ROWS)), features, rows)) if r.chosen else (r, None) for r in grid.collect()]
            own = [c for _, c in made if c]
            for c in own:
                c.silhouette = next(r.silhouette for r, x in made if x is c)  # over the rows that aren't noise
            listed += [(Candidate(method, f"eps={r.eps},least={r.least}", r.clusters, 0, r.silhouette, None, df), r.note) for r, c in made if c is None]
        elif method == "gmm":
            own = gmm_candidates(df, features, ks)
        else:
            own = [c for _, c, _ in _fitted(df, features, method, tuple(k for k in ks if k < n))]
        if own:
            winner = min(own, key=lambda c: c.bic) if method == "gmm" else max(own, key=lambda c: c.silhouette)
            best.append(winner)
            listed += [(c, "best of its method" if c is winner else "higher BIC" if method == "gmm" else "lower silhouette than another of its method") for c in own]
    failed = {id(c): "too few clusters" if c.clusters < min_clusters else "a cluster is too small" for c in best if c.clusters < min_clusters or c.smallest < bound}
    valid = [c for c in best if id(c) not in failed]
    top = max(valid, key=lambda c: c.silhouette) if valid else None
    if top and floor is not None and top.silhouette < floor:
        failed[id(top)] = "silhouette below the floor"
    chosen = top if top and id(top) not in failed else None
    rows = [(c.method, c.setting, c.clusters, c.smallest, None if c.silhouette is None else round(c.silhouette, 6), None if c.bic is None else round(c.bic, 2), failed.get(id(c), "chosen" if c is chosen else why), c is chosen) for c, why in listed]
    diagnostics = df.sparkSession.createDataFrame(rows, "method string, setting string, clusters long, smallest long, silhouette double, bic double, reason string, chosen boolean")  # a row for each candidate
    if chosen is None:
        raise ClusteringError(f"no clustering is valid: at least {min_clusters} clusters of {bound} rows, silhouette floor {floor}", diagnostics)
    return diagnostics, chosen.rows


def profile(clustered: DataFrame, features: list[str], target: str) -> DataFrame:
    """Mean and deviation of each feature by cluster, the overall mean, size and outcome rate."""
    t = clustered.select("cluster", F.col(target).alias("_y"), F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features))))
    g = t.groupBy("cluster", "feature").agg(F.count("*").alias("n"), F.count("v").alias("m"), F.sum("v").alias("s"), F.round(F.stddev_samp("v"), 6).alias("std"), F.round(F.avg("_y"), 6).alias("rate"))
    w = Window.partitionBy("feature")
    return g.select("cluster", "feature", "n", F.round(F.col("s") / F.col("m"), 6).alias("mean"), "std", F.round(F.sum("s").over(w) / F.sum("m").over(w), 6).alias("overall"), "rate")


def balance_gate(clustered: DataFrame, most: float = 0.8) -> DataFrame:
    """Evidence is refused for fewer than two clusters or one with more than `most` of the rows."""
    t = clustered.groupBy("cluster").agg(F.count("*").alias("n")).agg(F.count("*").alias("clusters"), (F.max("n") / F.sum("n")).alias("share"))
    return t.select("clusters", F.round("share", 6).alias("largest_share"), ((F.col("clusters") >= 2) & (F.col("share") <= most)).alias("accepted"))


def recommend(clustered: DataFrame, target: str) -> DataFrame:
    """Clusters whose outcome rate is at least 1.5 (P1) or 3 (P0) times the overall one."""
    g = clustered.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(F.col(target).cast("double")).alias("rate"))
    w = Window.partitionBy()
    t = g.withColumn("ratio", F.round(F.col("rate") / (F.sum(F.col("rate") * F.col("n")).over(w) / F.sum("n").over(w)), 6))
    return t.select("cluster", "n", F.round("rate", 6).alias("rate"), "ratio", F.when(F.col("ratio") >= 3, "P0").when(F.col("ratio") >= 1.5, "P1").otherwise("none").alias("priority"))
