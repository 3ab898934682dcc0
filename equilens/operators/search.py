"""Search over training settings: parameters, multipliers, chained mitigations and whole grids of configurations.

Each fit is a distributed job; the driver runs a bounded list of configurations and sees only their measures.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.operators import models as M
from equilens.operators import preparation as P
from equilens.operators import thresholds as H
from equilens.operators.graph import checkpointed

#: Mean recall below which a setting is reported as too low.
RECALL_FLOOR = 0.6
#: Jobs that are submitted at once.
PARALLEL = 4
STAGES = ("pre", "in", "post")


def gaps(df: DataFrame, label: str, group: str, keys: list[str] = ()) -> DataFrame:
    """(keys, accuracy, recall, dp_gap, tpr_gap, fpr_gap) of predictions, over groups."""
    of = lambda c: F.avg(F.when(c, F.col("y_pred")))
    t = df.groupBy(*keys, group).agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == F.col("y_pred")).alias("hits"), F.count_if((F.col(label) == 1) & (F.col("y_pred") == 1)).alias("tp"), F.count_if(F.col(label) == 1).alias("p"),
        F.avg("y_pred").alias("rate"), of(F.col(label) == 1).alias("tpr"), of(F.col(label) == 0).alias("fpr"),
    )
    gap = lambda m: F.round(F.max(m) - F.min(m), 4)
    whole = [F.round(F.sum("hits") / F.sum("n"), 4).alias("accuracy"), F.round(F.sum("tp") / F.nullif(F.sum("p"), F.lit(0)), 4).alias("recall")]
    return t.groupBy(*keys).agg(*whole, gap("rate").alias("dp_gap"), gap("tpr").alias("tpr_gap"), gap("fpr").alias("fpr_gap"))


def hpo_search(df: DataFrame, key: str, features: list[str], label: str, grid: dict[str, list], fit: M.Fit = M.train_logistic, k: int = 3) -> DataFrame:
    """(setting, f1, recall, below_floor, place): mean measures over stratified folds, imputed and scaled by training rows alone."""
    folded = P.folds_stratified(df.select(key, *features, label), key, [label], k)
    ready = P.fold_preprocess(folded, features, "fold", k).persist()
    settings = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]

    def score(setting: dict, fold: int) -> DataFrame:
        own = ready.where(F.col("fold_no") == fold)
        model = fit(own.where("side = 'train'"), features, label, **setting)
        return M.predict(model, own.where("side = 'test'"), features).select(F.lit(str(setting)).alias("setting"), F.lit(fold).alias("fold"), label, "y_pred")

    try:
        with ThreadPoolExecutor(PARALLEL) as pool:
            parts = list(pool.map(lambda job: score(*job), [(s, f) for s in settings for f in range(k)]))
        hit = lambda c: F.count_if(c)
        per = reduce(DataFrame.unionByName, parts).groupBy("setting", "fold").agg(
            hit((F.col(label) == 1) & (F.col("y_pred") == 1)).alias("tp"), hit((F.col(label) == 0) & (F.col("y_pred") == 1)).alias("fp"), hit((F.col(label) == 1) & (F.col("y_pred") == 0)).alias("fn")
        )
        f1 = 2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1))
        mean = per.groupBy("setting").agg(F.round(F.avg(f1), 4).alias("f1"), F.round(F.avg(F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))), 4).alias("recall"))
        rows = mean.withColumn("below_floor", F.col("recall") < RECALL_FLOOR).orderBy(F.desc("f1"), "setting").collect()  # a row for each setting
    finally:
        ready.unpersist()
    return df.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rows, 1)], "setting string, f1 double, recall double, below_floor boolean, place int")


def lattice(dimensions: int, points: int) -> list[tuple[int, ...]]:
    """Whole vectors by rising sum of absolute values: all of the small ones, and of the last sum as many, spread evenly, as `points` leaves."""

    def shell(d: int, total: int) -> list[tuple[int, ...]]:
        if d == 0:
            return [()] if total == 0 else []
        return [(x, *rest) for x in range(-total, total + 1) for rest in shell(d - 1, total - abs(x))]

    found: list[tuple[int, ...]] = []
    units = 0
    while len(found) < points and (units == 0 or dimensions):
        own, left = shell(dimensions, units), points - len(found)
        found += own if len(own) <= left else [own[i * len(own) // left] for i in range(left)]
        units += 1
    return found


def grid_search(df: DataFrame, features: list[str], label: str, group: str, points: int = 20, most: float = 2.0, fit: M.Fit = M.train_logistic, constraint: str = "equalized_odds", weight: float = 0.5) -> DataFrame:
    """(point, multipliers, error, recall, gaps, violation, objective, chosen): a fit for each point of a lattice of signed multipliers.

    For each event (all rows, or a label) every group but the last has a multiplier, which its selections pay and the
    others get. The points are those of `lattice`, scaled so that the largest sum of absolute values is `most`. The
    objective is the error and the largest distance of a cell's rate from its event's, weighted; the least one is
    chosen, the earlier point (which pushes less) on ties.
    """
    known = df.where(F.col(label).isNotNull()).persist()
    try:
        game = M.Reduction(known, features, label, group, constraint, fit)
        last = {c[1:]: c for c in game.cells}
        free = [c for c in game.cells if last[c[1:]] != c]
        vectors = lattice(len(free), points)
        scale = most / max(1, max(sum(map(abs, v)) for v in vectors))

        def one(job: tuple[int, tuple[int, ...]]) -> tuple:
            at, vector = job
            push = dict.fromkeys(game.cells, 0.0) | {c: scale * x for c, x in zip(free, vector)}
            model = game.respond(push)
            error, off = game.effect(model)
            r = gaps(M.predict(model, known, features), label, group).first()
            violation = max((abs(v) for v in off.values()), default=0.0)
            named = ",".join(f"{'|'.join(map(str, c))}={scale * x:g}" for c, x in zip(free, vector) if x)
            return (at, named, round(error, 6), r.recall, r.dp_gap, r.tpr_gap, r.fpr_gap, round(violation, 6), round((1 - weight) * error + weight * violation, 6))

        with ThreadPoolExecutor(PARALLEL) as pool:
            found = list(pool.map(one, enumerate(vectors)))
    finally:
        known.unpersist()
    best = min(found, key=lambda r: (r[-1], r[0]))[0]
    schema = "point int, multipliers string, error double, recall double, dp_gap double, tpr_gap double, fpr_gap double, violation double, objective double, chosen boolean"
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in found], schema)  # a row for each point


#: Techniques: their stage and what they do to the run's parts (train, fit, thresholds).
def _reweighted(run: dict, key: str, label: str, group: str) -> dict:
    return run | {"train": P.reweight(run["train"], label, group), "weight": "weight"}


def _resampled(op: Callable[..., DataFrame], run: dict, key: str, label: str, group: str) -> dict:
    return run | {"train": op(run["train"], key, label).drop("_copy")}


def _constrained(run: dict, key: str, label: str, group: str) -> dict:
    return run | {"mixture": True}


def _thresholds(run: dict, key: str, label: str, group: str) -> dict:
    return run | {"thresholds": "demographic_parity"}


TECHNIQUES = {
    "reweight": ("pre", _reweighted), "oversample": ("pre", partial(_resampled, P.oversample)), "undersample": ("pre", partial(_resampled, P.undersample)),
    "exp_gradient": ("in", _constrained), "thresholds": ("post", _thresholds),
}


def mit_combo(train: DataFrame, test: DataFrame, key: str, features: list[str], label: str, group: str, techniques: list[str], steps: int = 5) -> DataFrame:
    """Test rows with predictions after a chain of mitigations: any before training, at most one in it, at most one after it, in this order."""
    stages = [STAGES.index(TECHNIQUES[t][0]) for t in techniques]
    if stages != sorted(stages) or stages.count(1) > 1 or stages.count(2) > 1:
        raise ValueError(f"not a chain of pre*, in?, post?: {techniques}")
    run = {"train": train, "weight": None, "mixture": False, "thresholds": None}
    for t in techniques:
        run = TECHNIQUES[t][1](run, key, label, group)
    if run["mixture"]:
        mixture = M.exponentiated_gradient(run["train"], features, label, group, steps=steps)
        scored = lambda df: M.predict_mixture(mixture, df, features)
    else:
        model = M.train_logistic(run["train"], features, label, run["weight"])
        scored = lambda df: M.predict(model, df, features)
    out = scored(test)
    if not run["thresholds"]:
        return out
    fitted = H.fit_thresholds(scored(train), group, label, "y_proba", run["thresholds"])
    return H.apply_thresholds(out, fitted, group, "y_proba", key)


def mit_matrix(train: DataFrame, test: DataFrame, key: str, features: list[str], label: str, groups: list[str], chains: list[list[str]]) -> DataFrame:
    """(technique, attr, accuracy, recall, gaps, error): every chain for every attribute; a chain that fails is a row with its error."""
    rows = []

    def one(job: tuple[list[str], str]) -> tuple:
        chain, group = job
        name = "+".join(chain) or "baseline"
        try:
            return (name, group, *gaps(mit_combo(train, test, key, features, label, group, chain), label, group).first(), None)
        except ValueError as e:
            return (name, group, None, None, None, None, None, str(e))

    with ThreadPoolExecutor(PARALLEL) as pool:
        rows = list(pool.map(one, [(c, g) for c in chains for g in groups]))
    schema = "technique string, attr string, accuracy double, recall double, dp_gap double, tpr_gap double, fpr_gap double, error string"
    return train.sparkSession.createDataFrame(rows, schema)


#: Models of a sweep.
FITS = {"logistic": M.train_logistic, "forest": partial(M.train_forest, trees=10, depth=5), "boosted": partial(M.train_boosted, rounds=5), "svm": M.train_svm}
#: What a configuration is made of; columns that a plan lacks have these values.
AXES = {"dataset": "all", "binning": "none", "mitigation": "baseline", "method": "holdout", "model": "logistic"}
MEASURES = ("accuracy", "recall", "dp_gap", "tpr_gap", "fpr_gap")
RESULT = ", ".join([*(f"{a} string" for a in AXES), *(f"{m} double" for m in MEASURES), "recall_gate string, fairness_gate string, error string"])


def _trained(rows: DataFrame, asked: DataFrame, key: str, features: list[str], label: str, group: str, model: str, mitigation: str) -> DataFrame:
    """`asked` with predictions of a model of `rows` under a mitigation."""
    fit, weight = FITS[model], None
    if mitigation == "reweight":
        rows, weight = P.reweight(rows, label, group), "weight"
    elif mitigation in ("oversample", "undersample"):
        rows = {"oversample": P.oversample, "undersample": P.undersample}[mitigation](rows, key, label).drop("_copy")
    elif mitigation not in ("baseline", "thresholds"):
        raise ValueError(f"unknown mitigation: {mitigation}")
    made = fit(rows, features, label, weight)
    out = M.predict(made, asked, features)
    if mitigation != "thresholds":
        return out
    fitted = H.fit_thresholds(M.predict(made, rows, features), group, label, "y_proba", H.BOTH_RATES)
    return H.apply_thresholds(out, fitted, group, "y_proba", key)


def _gated(measures: dict[str, float | None]) -> tuple[str, str]:
    recall = measures["recall"] or 0.0
    return "fail" if recall < 0.6 else "lower_tier" if recall < 0.7 else "full_pass", "fail" if (measures["dp_gap"] or 0.0) > 0.1 else "pass"


def sweep(tables: dict[tuple[str, str], tuple[DataFrame, DataFrame]], key: str, features: list[str], label: str, group: str, plan: DataFrame, folds: int = 5, folder: str | None = None) -> DataFrame:
    """(dataset, binning, mitigation, method, model, measures, gates, error): every configuration of `plan` is run once.

    `tables` has the training and test rows of each dataset and binning. With method `holdout` a model of the training
    rows is measured on the test rows, with `cv` models of all but one fold of the training rows on that fold, and the
    measures are means over the folds. What folds need (draw, medians, scales) is made once for a table, written to the
    shared folder and used by all of its configurations. A configuration that fails is a row with its error; the others
    go on. With `folder` every finished configuration is noted there at once, and a sweep over the same folder runs only
    what is not noted; delete the notes of failures to run them again. Few rows: the driver holds the configurations.
    """
    spark = plan.sparkSession
    named = plan.select(*((F.coalesce(F.col(a).cast("string"), F.lit(v)) if a in plan.columns else F.lit(v)).alias(a) for a, v in AXES.items())).distinct()
    noted = spark.createDataFrame([], RESULT)
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            noted = spark.read.schema(RESULT).option("recursiveFileLookup", True).json(folder)
    done = [tuple(r) for r in noted.join(named, list(AXES), "left_semi").select(*AXES, *MEASURES, "recall_gate", "fairness_gate", "error").collect()]
    known = {r[: len(AXES)] for r in done}
    jobs = [r for r in sorted(tuple(r) for r in named.collect()) if r not in known]  # a row for each configuration
    folded = {}
    for dataset, binning in sorted({(d, b) for d, b, _, method, _ in jobs if method == "cv" and (d, b) in tables}):
        rows = P.folds_stratified(tables[dataset, binning][0].select(key, *features, label, group), key, [label], folds)
        folded[dataset, binning] = checkpointed(P.fold_preprocess(rows, features, "fold", folds))

    def measured(job: tuple[str, ...]) -> dict[str, float | None]:
        dataset, binning, mitigation, method, model = job
        if (dataset, binning) not in tables:
            raise ValueError(f"no table of {dataset} and {binning}")
        if model not in FITS or method not in ("holdout", "cv"):
            raise ValueError(f"unknown model or method: {model}, {method}")
        if method == "holdout":
            train, test = tables[dataset, binning]
            return gaps(_trained(train, test, key, features, label, group, model, mitigation), label, group).first().asDict()
        parts = []
        for fold in range(folds):
            own = folded[dataset, binning].where(F.col("fold_no") == fold)
            parts.append(gaps(_trained(own.where("side = 'train'"), own.where("side = 'test'"), key, features, label, group, model, mitigation), label, group).first())
        mean = lambda m: [p[m] for p in parts if p[m] is not None]
        return {m: round(sum(mean(m)) / len(mean(m)), 4) if mean(m) else None for m in MEASURES}

    def one(job: tuple[str, ...]) -> tuple:
        try:
            found = measured(job)
            row = (*job, *(found[m] for m in MEASURES), *_gated(found), None)
        except (ValueError, PySparkException, Py4JError) as e:
            row = (*job, *[None] * len(MEASURES), None, None, str(e).splitlines()[0][:300])
        if folder:
            own = hashlib.md5("|".join(job).encode()).hexdigest()  # a folder for each, as several are written at once
            spark.createDataFrame([row], RESULT).coalesce(1).write.mode("overwrite").json(f"{folder}/{own}")
        return row

    with ThreadPoolExecutor(PARALLEL) as pool:
        done += pool.map(one, jobs)
    return spark.createDataFrame(done, RESULT)


def sweep_run(train: DataFrame, test: DataFrame, key: str, features: list[str], label: str, group: str, plan: DataFrame, folds: int = 5, folder: str | None = None) -> DataFrame:
    """`sweep` over the configurations of one dataset."""
    pairs = [tuple(r) for r in plan.select(*((F.col(a) if a in plan.columns else F.lit(AXES[a])).cast("string").alias(a) for a in ("dataset", "binning"))).distinct().collect()]
    return sweep(dict.fromkeys(pairs, (train, test)), key, features, label, group, plan, folds, folder)
