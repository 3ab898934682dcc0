"""Classifiers on MLlib, out-of-fold predictions, importances and training under a fairness constraint."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark import SparkContext
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equilens.operators.neighbours import standardized
from equilens.operators.perturbation import share_of
from equilens.operators.places import PART_PLACES, PARTS

#: fit(rows, features, label, weight or None) gives a model for `predict`.
Fit = Callable[..., object]


def _ready(df: DataFrame, features: list[str]) -> DataFrame:
    """Adds the vector `_x`; rows with a null feature are left out."""
    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df)


def without_summary(model):
    """`model` without the summary of its training.

    A model is shipped with the rows' function, and its summary would take the
    training table and the session along, which can't be shipped once a query
    of the session was observed.
    """
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model


def _fit(estimator, df: DataFrame, features: list[str], label: str, weight: str | None):
    estimator.setFeaturesCol("_x").setLabelCol(label)
    if weight:
        estimator.setWeightCol(weight)
    return without_summary(estimator.fit(_ready(df.where(F.col(label).isNotNull()), features)))


def _linear(estimator: type, df: DataFrame, features: list[str], label: str, weight: str | None, c: float):
    """A linear model with the ridge penalty 1 / (rows x c), on features as they are. Equal rows are one row with their number, or the sum of their weights: the loss is the same, and each of its many passes reads them once."""
    each = F.sum(F.col(weight).cast("double")) if weight else F.count("*").cast("double")
    same = df.groupBy(*features, label).agg(F.count("*").alias("_rows"), each.alias("_weight")).persist()
    try:
        n, found = same.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.count("*")).first()
        parts = max(1, min(PARTS, -(-found // PART_PLACES)))  # a pass is a task for each part
        return _fit(estimator(regParam=1 / (max(n, 1) * c), standardization=False, maxIter=100), same.coalesce(parts), features, label, "_weight")
    finally:
        same.unpersist()


def train_logistic(df: DataFrame, features: list[str], label: str, weight: str | None = None, c: float = 1.0):
    """Logistic regression with the ridge penalty 1 / (rows x c), on features as they are."""
    return _linear(LogisticRegression, df, features, label, weight, c)


def train_forest(df: DataFrame, features: list[str], label: str, weight: str | None = None, trees: int = 50, depth: int = 8, seed: int = 42):
    return _fit(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed), df, features, label, weight)


def train_boosted(df: DataFrame, features: list[str], label: str, weight: str | None = None, rounds: int = 20, depth: int = 4, seed: int = 42):
    return _fit(GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed), df, features, label, weight)


def train_svm(df: DataFrame, features: list[str], label: str, weight: str | None = None, c: float = 1.0):
    return _linear(LinearSVC, df, features, label, weight, c)


def predict(model, df: DataFrame, features: list[str]) -> DataFrame:
    """`df` with y_pred and y_proba (of a linear SVM: the logistic function of its margin)."""
    out = model.transform(_ready(df.drop("y_pred", "y_proba"), features))
    proba = vector_to_array("probability")[1] if "probability" in out.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    kept = [c for c in df.columns if c not in ("y_pred", "y_proba")]
    return out.select(*kept, proba.alias("y_proba"), F.col("prediction").cast("int").alias("y_pred"))


def feature_importance(model, df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, importance): absolute coefficients, or the trees' impurity gain."""
    values = model.featureImportances.toArray() if hasattr(model, "featureImportances") else abs(model.coefficients.toArray())
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


def cv_out_of_fold(df: DataFrame, features: list[str], label: str, fold: str, folds: int, fit: Fit = train_logistic) -> DataFrame:
    """Every row's prediction by a model that was fitted on the other folds."""
    out = None
    for k in range(folds):
        part = predict(fit(df.where(F.col(fold) != k), features, label), df.where(F.col(fold) == k), features)
        out = part if out is None else out.union(part)
    return out


def performance(df: DataFrame, label: str, keys: list[str] = ()) -> DataFrame:
    """n, accuracy, recall, precision and selection rate of y_pred, by `keys`."""
    hit = (F.col(label) == 1) & (F.col("y_pred") == 1)
    of = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 4)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg((F.col(label) == F.col("y_pred")).cast("int")), 4).alias("accuracy"), of(F.count_if(hit), F.count_if(F.col(label) == 1)).alias("recall"),
        of(F.count_if(hit), F.count_if(F.col("y_pred") == 1)).alias("precision"), F.round(F.avg("y_pred"), 4).alias("selection_rate"),
    )


class Reduction:
    """A fairness constraint as costs of selecting rows, and what a model's selections do to error and constraint.

    Cells are groups, or for equalized odds groups by label; `events` are what rates are compared within: all rows, or
    the rows of a label. Only counts by group and label come to the driver.
    """

    def __init__(self, df: DataFrame, features: list[str], label: str, group: str, constraint: str = "demographic_parity", fit: Fit = train_logistic):
        if constraint not in ("demographic_parity", "equalized_odds"):
            raise ValueError(f"unknown constraint: {constraint}")
        self.rows = df.where(F.col(label).isNotNull())
        self.features, self.label, self.group, self.fit = features, label, group, fit
        self.by_label = constraint == "equalized_odds"
        counts = {(r[0], int(r[1])): r[2] for r in self.rows.groupBy(group, F.col(label).cast("int")).agg(F.count("*")).collect()}
        self.counts = counts
        self.sizes: dict[tuple, int] = {}
        for (g, y), n in counts.items():
            self.sizes[self.cell(g, y)] = self.sizes.get(self.cell(g, y), 0) + n
        self.n = max(sum(counts.values()), 1)
        self.cells = sorted(self.sizes, key=lambda c: tuple((x is None, str(x)) for x in c))
        self.within = {c: sum(s for o, s in self.sizes.items() if o[1:] == c[1:]) for c in self.cells}

    def cell(self, g, y: int) -> tuple:
        return (g, y) if self.by_label else (g,)

    def respond(self, push: dict[tuple, float]):
        """The model that answers signed multipliers: every row gets the cheaper label, weighted by what the other would cost more."""
        cost = F.lit(0.0)
        for cell, size in self.sizes.items():
            # selecting a row moves its cell's rate by 1 / size and the event's rate by 1 / within
            mean = sum(push[o] for o in self.sizes if o[1:] == cell[1:]) / self.within[cell]
            same = F.col(self.group).eqNullSafe(F.lit(cell[0]))
            same = same & (F.col(self.label) == cell[1]) if self.by_label else same
            cost = F.when(same, F.lit(self.n * (push[cell] / size - mean))).otherwise(cost)
        gain = F.when(F.col(self.label) == 1, 1.0).otherwise(-1.0) - cost
        return self.fit(self.rows.withColumns({"_y": (gain > 0).cast("double"), "_w": F.abs(gain)}), self.features, "_y", "_w")

    def effect(self, model) -> tuple[float, dict[tuple, float]]:
        """(error, by how much each cell's rate is above its event's)."""
        made = predict(model, self.rows, self.features).groupBy(self.group, F.col(self.label).cast("int").alias("_l")).agg(F.sum("y_pred"))
        picked = {(r[0], r[1]): r[2] for r in made.collect()}
        wrong = sum(n - picked.get((g, y), 0) if y else picked.get((g, y), 0) for (g, y), n in self.counts.items())
        rate = {c: sum(picked.get(k, 0) for k in self.counts if self.cell(*k) == c) / self.sizes[c] for c in self.cells}
        event = {c: sum(rate[o] * self.sizes[o] for o in self.cells if o[1:] == c[1:]) / self.within[c] for c in self.cells}
        return wrong / self.n, {c: rate[c] - event[c] for c in self.cells}


@dataclass
class Mixture:
    """Models with the chances that they decide, the duality gap that was reached, and the gap of each step."""

    models: list
    weights: list[float]
    gap: float
    gaps: list[float]


def equilibrium(errors: np.ndarray, off: np.ndarray, eps: float, bound: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, push, value) of the game between known models and the multipliers, by the simplex method on a small table.

    The weights have the least error plus `bound` times what the largest |off| (models x cells) exceeds `eps` by; the
    signed push of each cell and the value come from the dual.
    """
    m, cells = off.shape
    sides = np.concatenate([off.T, -off.T])
    # columns: weights, the excess, a slack for each side; rows: the sides, and that the weights sum to 1
    t = np.zeros((2 * cells + 2, m + 1 + 2 * cells + 1))
    t[: 2 * cells, :m], t[: 2 * cells, m], t[: 2 * cells, m + 1 : -1], t[: 2 * cells, -1] = sides, -1, np.eye(2 * cells), eps
    t[2 * cells, :m], t[2 * cells, -1] = 1, 1
    t[-1, :m], t[-1, m] = errors, bound
    basis = [m + 1 + k for k in range(2 * cells)] + [0]

    def pivot(row: int, column: int) -> None:
        t[row] /= t[row, column]
        for r in np.flatnonzero(np.abs(t[:, column]) > 0):
            if r != row:
                t[r] -= t[r, column] * t[row]
        basis[row] = column

    pivot(2 * cells, 0)
    worst = int(t[: 2 * cells, -1].argmin()) if cells else 0
    if cells and t[worst, -1] < 0:
        pivot(worst, m)
    for _ in range(10_000):
        entering = np.flatnonzero(t[-1, :-1] < -1e-12)
        if not len(entering):
            break
        c = int(entering[0])
        rows = np.flatnonzero(t[:-1, c] > 1e-12)
        ratio = t[rows, -1] / t[rows, c]
        ties = rows[ratio <= ratio.min() + 1e-15]
        pivot(int(min(ties, key=lambda r: basis[r])), c)  # Bland's rule
    weights = np.zeros(m)
    for r, c in enumerate(basis):
        if c < m:
            weights[c] = max(t[r, -1], 0.0)
    price = t[-1, m + 1 : -1]
    return weights / weights.sum(), price[:cells] - price[cells:], float(-t[-1, -1])


def exponentiated_gradient(df: DataFrame, features: list[str], label: str, group: str, constraint: str = "demographic_parity", eps: float = 0.05, steps: int = 50, rate: float = 2.0, fit: Fit = train_logistic, tolerance: float = 0.01) -> Mixture:
    """A reduction to weighted classification, as a game of a mixture of models against multipliers of the constraint.

    A multiplier for each cell and sign grows with that side's violation; they sum to 1 / eps at most, and their
    logarithms move by `rate` x eps x violation. In each step a model answers the multipliers. The equilibrium of the
    models known so far gives the mixture's weights and the multipliers that hold it; what their best response, one more
    fit, gains against these multipliers is the duality gap: so much could any mixture be better. The best mixture is
    kept, and the steps end where its gap is at most `tolerance`. Without labelled rows there are no models.
    """
    df = df.persist()  # each step reads all rows some times
    bound = 1 / eps
    try:
        game = Reduction(df, features, label, group, constraint, fit)
        cells = game.cells
        theta = {(c, sign): 0.0 for c in cells for sign in (1, -1)}
        models, errors, off = [], [], []
        best, gaps = Mixture([], [], math.inf, []), []

        def known(push: dict[tuple, float]) -> int:
            models.append(game.respond(push))
            error, own = game.effect(models[-1])
            errors.append(error), off.append([own[c] for c in cells])
            return len(models) - 1

        for _ in range(steps if cells else 0):
            total = 1 + sum(math.exp(t) for t in theta.values())
            now = {k: bound * math.exp(t) / total for k, t in theta.items()}
            answer = known({c: now[c, 1] - now[c, -1] for c in cells})
            weights, push, value = equilibrium(np.array(errors), np.array(off), eps, bound)
            reply = known(dict(zip(cells, push.tolist())))
            gap = max(0.0, value - (errors[reply] + float(np.array(off[reply]) @ push) - eps * float(np.abs(push).sum())))
            if gap < best.gap:
                kept = np.flatnonzero(weights > 1e-9)
                best = Mixture([models[i] for i in kept], [float(weights[i]) for i in kept], gap, gaps)
            gaps.append(best.gap)
            if best.gap <= tolerance:
                break
            for (c, sign), t in theta.items():
                theta[c, sign] = t + rate / bound * (sign * off[answer][cells.index(c)] - eps)
    finally:
        df.unpersist()
    return best


def predict_mixture(mixture: Mixture, df: DataFrame, features: list[str]) -> DataFrame:
    """y_proba: the chance that a model which selects the row decides; y_pred: 1 with that chance, drawn by a hash of the features."""
    kept = [c for c in df.columns if c not in ("y_pred", "y_proba")]
    out, p = df.select(*kept), F.lit(0.0)
    for i, (m, w) in enumerate(zip(mixture.models, mixture.weights)):
        out = predict(m, out, features).withColumnRenamed("y_pred", f"_v{i}").drop("y_proba")
        p = p + F.lit(w) * F.col(f"_v{i}")
    return out.select(*kept, p.alias("y_proba"), (F.pmod(F.xxhash64(*features), F.lit(1_000_000)) / 1_000_000 < p).cast("int").alias("y_pred"))


def before_after(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, metric, before, after, change) of two tables with one row for each of `keys`."""
    long = lambda d, name: d.select(*keys, F.explode(F.create_map(*(x for v in values for x in (F.lit(v), F.col(v).cast("double"))))).alias("metric", name))
    t = long(before, "before").join(long(after, "after"), [*keys, "metric"], "full")
    return t.withColumn("change", F.round(F.col("after") - F.col("before"), 6))


def interpolations(df: DataFrame, key: str, features: list[str], label: str, bucket_rows: int = 10_000, by: str | None = None) -> DataFrame:
    """(key, features, label): each row mixed with another of its class (and group `by`, which stays), its neighbour in the order of a hash.

    Pairs are made in buckets of about `bucket_rows` rows of a class, so that no class meets in one task. A row that is
    alone in its bucket is mixed with itself. `key` becomes -key - 1, which no row has that is numbered from 0.
    """
    buckets = max(1, -(-df.count() // bucket_rows))
    more = [by] if by else []
    t = df.select(key, label, *more, *(F.col(f).cast("double") for f in features)).dropna().withColumns({"_b": F.floor(share_of(key, "bucket") * buckets), "_u": share_of(key, "pair"), "_a": share_of(key, "mix")})
    part = Window.partitionBy(label, *more, "_b")
    nexts = {f"_{f}": F.coalesce(F.lead(f).over(part.orderBy("_u", key)), F.first(f).over(part.orderBy("_u", key))) for f in features}
    t = t.withColumns(nexts)
    return t.select((-F.col(key) - 1).alias(key), *((F.col("_a") * F.col(f) + (1 - F.col("_a")) * F.col(f"_{f}")).alias(f) for f in features), label, *more)


def _class_mean(df: DataFrame, label: str, value: Column) -> Column:
    return F.round((F.avg(F.when(F.col(label) == 0, value)) + F.avg(F.when(F.col(label) == 1, value))) / 2, 4)


def complexity_l(df: DataFrame, key: str, features: list[str], label: str) -> DataFrame:
    """l1 (margins of the wrong rows), l2 (error), l3 (error on interpolations) of a linear SVM, averaged over the classes."""
    model = train_svm(df, features, label)
    margin = F.abs(vector_to_array("rawPrediction")[1])
    wrong = lambda d: model.transform(_ready(d, features)).withColumn("_wrong", (F.col("prediction") != F.col(label)).cast("double"))
    own = wrong(df).agg(_class_mean(df, label, margin * F.col("_wrong")).alias("l1"), _class_mean(df, label, F.col("_wrong")).alias("l2"))
    mixed = wrong(interpolations(df, key, features, label)).agg(_class_mean(df, label, F.col("_wrong")).alias("l3"))
    return own.crossJoin(mixed)  # one row each


def pca_2d(df: DataFrame, features: list[str], kept: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(`kept`, x, y) on the first two components of the z-scores, and (component, explained); at least two features."""
    z = _ready(standardized(df.select(*kept, *features).dropna(subset=features), features), features)
    model = PCA(k=2, inputCol="_x", outputCol="_p").fit(z)
    p = vector_to_array("_p")
    shares = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance.toArray())]
    return model.transform(z).select(*kept, p[0].alias("x"), p[1].alias("y")), df.sparkSession.createDataFrame(shares, "component int, explained double")
