"""Experiments against their baselines: deltas, gates, scores, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Weights of the composite score.
WEIGHTS = {"f1": 0.4, "recall": 0.3, "accuracy": 0.2, "auc": 0.1}


def exact_mean(column: str, places: int = 4) -> Column:
    """The mean of values that have `places` decimals, by whole numbers: the same in whatever order they are added up."""
    scale = 10**places
    return F.sum(F.round(F.col(column) * scale).cast("long")) / (F.count(column) * scale)


def composite_score(df: DataFrame) -> DataFrame:
    score = sum((F.col(m) * w for m, w in WEIGHTS.items()), F.lit(0.0))
    return df.withColumn("score", F.round(score, 6))


def gate_recall(recall: Column, floor: float = 0.6, least: float = 0.7) -> Column:
    return F.when(recall.isNull() | (recall < floor), "fail").when(recall < least, "lower_tier").otherwise("full_pass")


def gate_fairness(gap: Column) -> Column:
    return F.when(gap > 0.1, "fail").otherwise("pass")


def gate_annotate(df: DataFrame) -> DataFrame:
    return df.withColumns({"recall_gate": gate_recall(F.col("recall")), "fairness_gate": gate_fairness(F.col("gap"))})


def join_baseline(df: DataFrame) -> DataFrame:
    """Each experiment with its baseline: the same dataset, model, binning and variant, else any variant; and which rule matched."""
    base = df.where("mitigation = 'baseline'")
    exact = base.select("dataset", "model_type", "binning", "variant", F.struct("experiment_id", "f1", "recall", "gap").alias("b1"))
    first = base.groupBy("dataset", "model_type", "binning").agg(F.min_by(F.struct("experiment_id", "f1", "recall", "gap"), "experiment_id").alias("b2"))
    t = df.join(exact, ["dataset", "model_type", "binning", "variant"], "left").join(first, ["dataset", "model_type", "binning"], "left")
    return t.withColumn("b", F.coalesce("b1", "b2")).withColumn("baseline_source", F.when(F.col("b1").isNotNull(), "exact").when(F.col("b2").isNotNull(), "no_variant").otherwise("none")).drop("b1", "b2")


def baseline_deltas(df: DataFrame) -> DataFrame:
    t = join_baseline(df).where("mitigation <> 'baseline'")
    d = lambda m: F.round(F.col(m) - F.col(f"b.{m}"), 6).alias(f"{m}_delta")
    gain = F.col("b.gap") - F.col("gap")
    return t.select("experiment_id", F.col("b.experiment_id").alias("baseline_id"), "baseline_source", d("f1"), d("recall"), d("gap"), F.round(F.when(F.col("b.gap") > 0, 100 * gain / F.col("b.gap")), 4).alias("gain_pct"))


def metric_values_long(df: DataFrame) -> DataFrame:
    names = ("f1", "recall", "accuracy", "auc", "gap")
    return df.select("experiment_id", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names)))).where("value IS NOT NULL")


def metric_deltas_long(df: DataFrame) -> DataFrame:
    """delta, and improvement: the delta signed so that up is better."""
    names = ("f1", "recall", "gap")
    t = join_baseline(df).where("mitigation <> 'baseline'")
    long = t.select("experiment_id", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), (F.col(m) - F.col(f"b.{m}")).alias("delta")) for m in names)))).where("delta IS NOT NULL")
    return long.select("experiment_id", "metric", F.round("delta", 6).alias("delta"), F.round(F.when(F.col("metric") == "gap", -F.col("delta")).otherwise(F.col("delta")), 6).alias("improvement"))


def pareto_front(df: DataFrame) -> DataFrame:
    """Per dataset the experiments that none beats in score (more) and gap (less); ties stay. One sort instead of a join of all pairs."""
    s = composite_score(df)
    best = s.groupBy("dataset", "score").agg(F.min("gap").alias("_here"))
    above = Window.partitionBy("dataset").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("_above", F.min("_here").over(above)).where("_above IS NULL OR _here < _above")
    return s.join(best, ["dataset", "score"]).where("gap = _here").select("dataset", "experiment_id", "score", "gap")


def topk_tiered(df: DataFrame, k: int = 3) -> DataFrame:
    """Per dataset the best k: first those that pass both gates in full, then by score, gap and id."""
    s = gate_annotate(composite_score(df))
    tier = F.when((F.col("recall_gate") == "full_pass") & (F.col("fairness_gate") == "pass"), 1).when((F.col("recall_gate") != "fail") & (F.col("fairness_gate") == "pass"), 2).otherwise(3)
    w = Window.partitionBy("dataset").orderBy("tier", F.desc("score"), "gap", "experiment_id")
    return s.withColumn("tier", tier).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("dataset", "rank", "tier", "experiment_id", "score")


def best_per(df: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "gap", "experiment_id")
    return composite_score(df).withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, "experiment_id", "score", "gap")


def summary_stats(df: DataFrame, by: str = "mitigation") -> DataFrame:
    agg = [x for m in ("f1", "recall", "gap") for x in (F.round(F.avg(m), 6).alias(f"{m}_mean"), F.round(F.stddev_samp(m), 6).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"))]
    return df.groupBy(by).agg(F.count("*").alias("n"), *agg)


def pivot_score(df: DataFrame, rows: str, datasets: list[str]) -> DataFrame:
    """Mean score by `rows` and dataset, exact: scores are whole millionths, and a mean half-way between two goes up in whatever order they are added."""
    n, total = F.count("score"), F.sum(F.round(F.col("score") * 1_000_000).cast("long"))
    mean = F.floor((2 * total + n) / F.nullif(2 * n, F.lit(0))) / 1_000_000
    t = composite_score(df).groupBy(rows).pivot("dataset", datasets).agg(mean)
    return t.select(rows, *(F.col(d).alias(f"score_{d.lower()}") for d in datasets))


def mitigation_delta_matrix(df: DataFrame) -> DataFrame:
    t = join_baseline(df).where("mitigation <> 'baseline'")
    return t.groupBy("mitigation").agg(*(F.round(F.avg(F.col(m) - F.col(f"b.{m}")), 6).alias(f"{m}_delta") for m in ("f1", "recall", "gap")))


def experiment_index(df: DataFrame) -> DataFrame:
    return join_baseline(df).select("experiment_id", F.col("b.experiment_id").alias("baseline_id"), "baseline_source")


def rank_metric_difficulty(df: DataFrame, entity: str, metrics: list[str]) -> DataFrame:
    """Mean over metrics of the rank of an entity's mean value, the highest first, ties averaged."""
    means = df.groupBy(entity).agg(*(F.avg(m).alias(m) for m in metrics))
    long = means.select(entity, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.round(m, 9).alias("v")) for m in metrics))))
    rank = F.rank().over(Window.partitionBy("metric").orderBy(F.desc("v"))) + (F.count("*").over(Window.partitionBy("metric", "v")) - 1) / 2
    return long.withColumn("rank", rank).groupBy(entity).agg(F.round(F.avg("rank"), 4).alias("mean_rank"))


def cv_fold_aggregate(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    long = df.select(*keys, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics))))
    return long.groupBy(*keys, "metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("folds"))


def overfit_gap(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Train minus test for f1 and accuracy, and the risk that they show. Both have the keys, f1 and accuracy."""
    t = train.select(*keys, F.col("f1").alias("train_f1"), F.col("accuracy").alias("train_acc")).join(test.select(*keys, F.col("f1").alias("test_f1"), F.col("accuracy").alias("test_acc")), keys)
    gf, ga = F.col("train_f1") - F.col("test_f1"), F.col("train_acc") - F.col("test_acc")
    risk = F.when((F.col("train_f1") >= 0.98) | (gf >= 0.15) | (F.col("train_acc") >= 0.99), "high").when((gf >= 0.08) | (ga >= 0.08), "medium").otherwise("low")
    return t.select(*keys, F.round(gf, 4).alias("f1_gap"), F.round(ga, 4).alias("acc_gap"), risk.alias("risk"))


def join_overfit_risk(table: DataFrame, risk: DataFrame, keys: list[str]) -> DataFrame:
    """`table` with the risk of each of its rows, null where none is known; a repeated risk counts once."""
    return table.join(risk.dropDuplicates(keys), keys, "left")


def mode_scores(df: DataFrame) -> DataFrame:
    """Mean score of each variant and model, with its place within the model; for information only."""
    t = composite_score(df).groupBy("variant", "model_type").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count("*").alias("n"))
    return t.withColumn("place", F.rank().over(Window.partitionBy("model_type").orderBy(F.desc("mean_score"))))


def stage_gap_deltas(df: DataFrame, stage: str = "binning") -> DataFrame:
    """Change of the mean gap from one stage to the next, by dataset."""
    t = df.groupBy("dataset", F.col(stage).alias("stage")).agg(F.round(exact_mean("gap"), 9).alias("mean_gap"))
    before = F.lag("mean_gap").over(Window.partitionBy("dataset").orderBy("stage"))
    return t.withColumn("change", F.round(F.col("mean_gap") - before, 9))


def before_after_best(df: DataFrame, metrics: tuple[str, ...] = ("f1", "recall", "gap")) -> DataFrame:
    """Each metric of a dataset's first baseline and of its mitigated experiment with the least gap."""
    row, base = F.struct(*metrics), F.col("mitigation") == "baseline"
    t = df.groupBy("dataset").agg(F.min_by(row, F.when(base, F.col("experiment_id"))).alias("b"), F.min_by(row, F.when(~base, F.struct("gap", "experiment_id"))).alias("a"))
    long = t.where("a IS NOT NULL AND b IS NOT NULL").select("dataset", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"b.{m}").alias("before"), F.col(f"a.{m}").alias("after")) for m in metrics))))
    return long.withColumn("change", F.round(F.col("after") - F.col("before"), 6))


def experiment_summary(df: DataFrame) -> DataFrame:
    names = {"dataset": "datasets", "model_type": "models", "binning": "binnings", "mitigation": "mitigations"}
    return df.agg(F.count("*").alias("experiments"), *(F.countDistinct(c).alias(n) for c, n in names.items()))


def mitigation_gap_matrix(df: DataFrame, datasets: tuple[str, ...] = ("A", "N", "R")) -> DataFrame:
    return df.groupBy("mitigation").agg(*(F.round(F.avg(F.when(F.col("dataset") == d, F.col("gap"))), 6).alias(f"gap_{d.lower()}") for d in datasets))
