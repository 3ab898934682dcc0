"""Audits of whole runs: every dataset, model and split in one grouping, and the tables made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equilens.operators import fairness as A
from equilens.operators.harmonize import GROUP_VIEWS

#: Largest gap at which a cluster counts as fair; gaps at it pass.
CLUSTER_FAIR = 0.10


def fairness_summary(df: DataFrame, attrs: list[str], metrics: list[str]) -> DataFrame:
    """(attr, metric, max_difference, is_fair, groups): one row for each attribute and metric."""
    t = A.fairness_metrics(df, attrs, metrics)
    return t.groupBy("attr", "metric").agg(F.max("max_difference").alias("max_difference"), F.bool_and("is_fair").alias("is_fair"), F.count("*").alias("groups"))


def group_support(df: DataFrame, attrs: list[str], least: int = A.LEAST_ROWS) -> DataFrame:
    """(attr, grp, n, kept): groups with enough rows, and those that are skipped."""
    t = A.by_attribute(df, attrs, []).groupBy("attr", "grp").agg(F.count("*").alias("n"))
    return t.withColumn("kept", F.col("n") >= least)


def degenerate_groups(df: DataFrame, attrs: list[str], least: int = A.LEAST_ROWS) -> DataFrame:
    """(attr, grp, n, reason) of the groups with enough rows but one class only."""
    t = A.group_status(df, attrs, least).where("status = 'degenerate'")
    return t.select("attr", "grp", "n", F.when(F.col("tp") + F.col("fn") == 0, "no_positives").otherwise("no_negatives").alias("reason"))


def group_view_report(df: DataFrame) -> DataFrame:
    """The gated report over the views of `derive_group_views`; cells of intersections need fewer rows."""
    least = {v: A.LEAST_CELL_ROWS if len(parts) > 1 else A.LEAST_ROWS for v, parts in GROUP_VIEWS.items()}
    exploratory = F.col("attr").isin(*(v for v, parts in GROUP_VIEWS.items() if len(parts) > 1))
    return A.gated_report(df, list(GROUP_VIEWS), least).withColumn("exploratory", exploratory)


def subgroup_rows(df: DataFrame, attrs: list[str], run: list[str]) -> DataFrame:
    """A flat row for each run, attribute and group: performance, the group's flags, and the gaps of its attribute."""
    keys = [*run, "attr", "grp"]
    flags = A.gated_report(df, attrs, extra=run).select(*keys, "status", "dp_gap", "tpr_gap", "fpr_gap")
    perf = A.group_performance(df, attrs, run).select(*keys, "n", "prevalence", "accuracy", "recall", "auc")
    t = perf.join(flags, keys)
    return t.withColumns({"degenerate": F.col("status") == "degenerate", "policy_excluded": F.col("status") == "unknown"}).drop("status")


def assess_run(df: DataFrame, attrs: list[str], run: list[str]) -> DataFrame:
    """(run, attr, metric, max_difference, is_fair) of all metrics for every run, whatever their number, in one grouping."""
    t = A.fairness_metrics(df, attrs, list(A.METRICS), run)
    return t.groupBy(*run, "attr", "metric").agg(F.max("max_difference").alias("max_difference"), F.bool_and("is_fair").alias("is_fair"))


def train_test_gap(assessed: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """Largest differences in training and test side by side, and by how much they grew."""
    of = lambda s: F.max(F.when(F.col(split) == s, F.col("max_difference")))
    t = assessed.groupBy(*keys, "attr", "metric").agg(of("train").alias("train_difference"), of("test").alias("test_difference"))
    return t.where("train_difference IS NOT NULL AND test_difference IS NOT NULL").withColumn("delta", F.round(F.col("test_difference") - F.col("train_difference"), 6))


def fairness_by_cluster(df: DataFrame, cluster: str, attrs: list[str], least: int = A.LEAST_ROWS) -> DataFrame:
    """Gaps of each cluster and attribute, four decimals; clusters with too few rows are skipped."""
    t = A.rates(A.group_counts(df.where(F.col(cluster).isNotNull()), attrs, [cluster]))
    gap = lambda m: F.max(m) - F.min(m)
    g = t.groupBy(cluster, "attr").agg(gap("positive_rate").alias("dp"), gap("tpr").alias("tpr"), gap("fpr").alias("fpr"))
    sizes = df.groupBy(cluster).agg(F.count("*").alias("n_samples")).where(F.col("n_samples") >= least)
    worst = F.greatest("dp", "tpr", "fpr")
    shown = [F.bround(m, 4).alias(n) for m, n in (("dp", "dp_max_diff"), ("tpr", "eo_tpr_diff"), ("fpr", "eo_fpr_diff"))]
    return g.join(F.broadcast(sizes), cluster).select(cluster, "attr", *shown, "n_samples", (F.round(worst, 9) <= CLUSTER_FAIR).alias("is_fair"))  # a row for each cluster


def per_group_flatten(df: DataFrame, attrs: list[str], run: list[str] = ()) -> DataFrame:
    """(run, attr, grp, metric, value, overall, n, positives, negatives): nested metrics as rows, with the value over all groups."""
    c, metrics = F.col, ("positive_rate", "tpr", "fpr", "fnr", "precision")
    counts = ["n", "tp", "fp", "tn", "fn"]
    own = A.group_counts(df, attrs, run)
    w = Window.partitionBy(*run, "attr")  # a row for each group
    whole = own.withColumns({k: F.sum(k).over(w) for k in counts})
    listed = F.array(*(F.struct(F.lit(m).alias("metric"), F.round(m, 6).alias("value")) for m in metrics))
    long = lambda t, name, more: A.rates(t).select(*run, "attr", "grp", *more, F.inline(listed)).withColumnRenamed("value", name)
    sides = ["n", (c("tp") + c("fn")).alias("positives"), (c("fp") + c("tn")).alias("negatives")]
    return long(own, "value", sides).join(long(whole, "overall", []), [*run, "attr", "grp", "metric"])


def fairness_gaps(df: DataFrame, attrs: list[str], run: list[str]) -> DataFrame:
    """(run, gap_dp, gap_full): the largest demographic parity gap over the attributes, and that of parity and odds."""
    t = A.rates(A.group_counts(df, attrs, run))
    gap = lambda m: F.max(m) - F.min(m)
    g = t.groupBy(*run, "attr").agg(gap("positive_rate").alias("dp"), gap("tpr").alias("tpr"), gap("fpr").alias("fpr"))
    return g.groupBy(*run).agg(F.round(F.max("dp"), 6).alias("gap_dp"), F.round(F.max(F.greatest("dp", "tpr", "fpr")), 6).alias("gap_full"))


def model_compare_rows(df: DataFrame, attrs: list[str], run: list[str]) -> DataFrame:
    """One row for each run: performance, and the gap of each metric over all attributes."""
    perf = A.confusion_metrics(df, run).select(*run, "n", "accuracy", "precision", "recall", "f1")
    t = A.fairness_metrics(df, attrs, ["demographic_parity", "equalized_odds"], run)
    gaps = t.groupBy(*run).pivot("metric", ["positive_rate", "tpr", "fpr"]).agg(F.max("max_difference"))
    return perf.join(gaps.withColumnsRenamed({"positive_rate": "dp_gap", "tpr": "tpr_gap", "fpr": "fpr_gap"}), run)


def auc_repair(recorded: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """(key, auc, repaired, reason): a recorded AUC of 0 is computed anew from the saved scores.

    Not from scores that are the hard labels, nor from a single class or score: then it is null, with a reason.
    """
    kept = predictions.where("y_true IS NOT NULL AND y_proba IS NOT NULL")
    hard = F.bool_and((F.col("y_proba").isin(0.0, 1.0)) & (F.col("y_proba") == F.col("y_pred")))
    guard = kept.groupBy(key).agg(hard.alias("_hard"), (F.min("y_proba") < F.max("y_proba")).alias("_varies"))
    found = A.roc_auc(kept, [key]).withColumnRenamed("auc", "_auc").join(guard, key)
    usable = found.withColumn("_auc", F.when(F.col("_varies") & ~F.coalesce("_hard", F.lit(False)), F.col("_auc"))).select(key, "_auc")
    t = recorded.join(usable, key, "left")
    zero = F.col("auc") == 0
    auc = F.when(zero, F.col("_auc")).otherwise(F.col("auc"))
    return t.select(key, auc.alias("auc"), F.coalesce(zero & F.col("_auc").isNotNull(), F.lit(False)).alias("repaired"), F.when(auc.isNull(), "missing_probability_scores").alias("reason"))


def shap_aggregate(long: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Mean, deviation and quartiles of the absolute attributions of each feature; `long` has (feature, value)."""
    v = F.abs("value")
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    t = long.groupBy(*keys, "feature").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), q.alias("q"))
    return t.select(*keys, "feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p25", "p50", "p75"))))


def shap_dataset_summary(per_run: DataFrame) -> DataFrame:
    """Over the runs of a dataset: how many, and the spread of each feature's mean attribution."""
    q = F.percentile("mean", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    t = per_run.groupBy("feature").agg(F.count("*").alias("runs"), F.avg("mean").alias("m"), F.stddev_samp("mean").alias("s"), F.min("mean").alias("min"), F.max("mean").alias("max"), q.alias("q"))
    return t.select("feature", "runs", F.round("m", 6).alias("mean"), F.round("s", 6).alias("std"), "min", "max", *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3"))))


def collect_folds(parts: dict[int, DataFrame]) -> DataFrame:
    """The rows of all folds, with their fold; columns that one lacks are null."""
    out = None
    for fold, part in parts.items():
        own = part.withColumn("fold", F.lit(fold))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def overfit_flag(auc: Column, f1: Column, accuracy: Column) -> Column:
    """Whether training results are too good to be true; missing ones don't count."""
    return F.coalesce(auc >= 0.98, F.lit(False)) | F.coalesce(f1 >= 0.98, F.lit(False)) | F.coalesce(accuracy >= 0.99, F.lit(False))
