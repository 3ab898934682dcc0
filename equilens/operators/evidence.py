"""Evidence of mitigation: values and deltas by group, the best rows under fall-back rules, and the tables for reports.

Tables of experiments have a row for each experiment; windows over them are over those rows, never over data rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equilens.functions.scalars import normalize_attr_name
from equilens.operators.experiments import composite_score, gate_recall, join_baseline

KEYS = ["dataset", "model_type", "binning", "variant"]
#: Metrics of a group of which more is better, and of which less is.
MORE_IS_BETTER, LESS_IS_BETTER = ("tpr", "equal_opportunity_tpr", "predictive_parity_precision"), ("fpr", "fnr")
LEAST_RECALL_DELTA = -0.03
EPSILON = 1e-12


def with_gains(df: DataFrame) -> DataFrame:
    """Mitigated experiments with gap_gain (up is better) and the deltas to their baseline."""
    t = join_baseline(df).where("mitigation <> 'baseline'")
    deltas = {f"{m}_delta": F.round(F.col(m) - F.col(f"b.{m}"), 6) for m in ("f1", "recall")}
    return t.withColumns({"gap_gain": F.round(F.col("b.gap") - F.col("gap"), 6), **deltas}).drop("b")


def group_metric_values(values: DataFrame) -> DataFrame:
    """Values by group under normalised attribute names, with the direction of their metric; missing values go."""
    better = ~F.col("metric").isin(*LESS_IS_BETTER)
    return values.where("value IS NOT NULL").withColumns({"attr": normalize_attr_name(F.col("attr")), "higher_is_better": better})


def join_baseline_per_group(values: DataFrame, baselines: DataFrame, assessed: DataFrame) -> DataFrame:
    """`values` with the value of the same attribute, group and metric in the baseline, and which rule found it.

    An experiment's baseline is the last one of its dataset, model, binning and variant, else the first one of any
    variant, else the assessment of its dataset and model.
    """
    same = ["attr", "grp", "metric"]
    runs = baselines.select(*KEYS, "experiment_id").distinct()
    exact = runs.groupBy(*KEYS).agg(F.max("experiment_id").alias("_exact"))
    first = runs.groupBy(*KEYS[:3]).agg(F.min("experiment_id").alias("_first"))
    t = values.withColumn("attr", normalize_attr_name(F.col("attr"))).join(exact, KEYS, "left").join(first, KEYS[:3], "left")
    source = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_first").isNotNull(), "no_variant").otherwise("assessment")
    t = t.withColumns({"baseline_id": F.coalesce("_exact", "_first"), "baseline_source": source}).drop("_exact", "_first")
    own = baselines.select(F.col("experiment_id").alias("baseline_id"), normalize_attr_name(F.col("attr")).alias("attr"), "grp", "metric", F.struct("value", "overall").alias("_own"))
    other = assessed.select("dataset", "model_type", normalize_attr_name(F.col("attr")).alias("attr"), "grp", "metric", F.struct("value", "overall").alias("_other"))
    t = t.join(own, ["baseline_id", *same], "left").join(other, ["dataset", "model_type", *same], "left")
    found = F.when(F.col("baseline_source") == "assessment", F.col("_other")).otherwise(F.col("_own"))
    return t.withColumns({"baseline_value": found["value"], "baseline_overall": found["overall"]}).drop("_own", "_other")


def group_metric_deltas(paired: DataFrame) -> DataFrame:
    """delta, and improvement: up for rates of hits, down for rates of errors, and a smaller distance to the overall selection rate."""
    c = F.col
    delta = c("value") - c("baseline_value")
    before, after = F.abs(c("baseline_value") - c("baseline_overall")), F.abs(c("value") - c("overall"))
    is_rate = c("metric") == "demographic_parity_rate"
    improvement = F.when(is_rate, before - after).when(c("metric").isin(*LESS_IS_BETTER), -delta).otherwise(delta)
    t = paired.where("mitigation <> 'baseline'").withColumns({"delta": F.round(delta, 6), "improvement": F.round(improvement, 6), "distance_improvement": F.round(F.when(is_rate, before - after), 6)})
    return t.where("improvement IS NOT NULL")


def tier() -> Column:
    """1 for a smaller gap at hardly less recall, 2 for a smaller gap, 3 for the rest; the least tier that occurs is eligible."""
    smaller = F.coalesce(F.col("gap_gain") > 0, F.lit(False))
    return F.when(smaller & F.coalesce(F.col("recall_delta") >= LEAST_RECALL_DELTA, F.lit(False)), 1).when(smaller, 2).otherwise(3)


def eligible(gains: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    return gains.withColumn("tier", tier()).withColumn("_least", F.min("tier").over(w)).where("tier = _least").drop("_least")


def best_first() -> list[Column]:
    return [F.desc_nulls_last("gap_gain"), F.desc_nulls_last("recall_delta"), F.desc_nulls_last("f1_delta"), F.asc("experiment_id")]


def evidence(gains: DataFrame, deltas: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    """The best row of each mitigation within `keys`, the `top` of them ranked, with its numbers of improved and worsened groups.

    Rows come from the least tier that occurs, and of them those with an AUC if there are any.
    """
    t = eligible(gains, keys)
    w = Window.partitionBy(*keys)
    has = F.col("auc").isNotNull()
    t = t.withColumn("_some", F.max(has).over(w)).where(has | ~F.col("_some")).withColumn("auc_unavailable", ~F.col("_some"))
    best = t.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "mitigation").orderBy(*best_first()))).where("_r = 1")
    ranked = best.withColumn("rank", F.row_number().over(w.orderBy(*best_first()))).where(F.col("rank") <= top)
    means = deltas.groupBy("experiment_id", "attr", "grp").agg(F.avg("improvement").alias("m"))
    counts = means.groupBy("experiment_id").agg(F.count_if(F.col("m") > EPSILON).alias("improved"), F.count_if(F.col("m") < -EPSILON).alias("worsened"))
    zero = F.lit(0).cast("long")
    shown = ["rank", "tier", "mitigation", "experiment_id", "gap_gain", "recall_delta", "f1_delta", "auc_unavailable"]
    sides = [F.coalesce(c, zero).alias(f"groups_{c}") for c in ("improved", "worsened")]
    return ranked.join(counts, "experiment_id", "left").select(*[k for k in keys if k not in shown], *shown, *sides)


def degraded(df: DataFrame, flags: DataFrame) -> DataFrame:
    """`df` with mitigation_degraded: whether the experiment's weights were rejected; no answer is no degradation."""
    first = flags.groupBy("experiment_id").agg(F.min("weight_applied").alias("_applied"))
    return df.join(first, "experiment_id", "left").withColumn("mitigation_degraded", F.coalesce(~F.col("_applied"), F.lit(False))).drop("_applied")


def degraded_warnings(df: DataFrame) -> DataFrame:
    """(model_type, experiments) of the families with degraded experiments."""
    return df.where("mitigation_degraded").groupBy("model_type").agg(F.count("*").alias("experiments"))


def gated_best(df: DataFrame, recall_floor: float = 0.6, least_recall: float = 0.7, most_gap: float = 0.1, most_drop: float = 0.15) -> DataFrame:
    """Mitigated experiments that pass the gates against the first baseline of their dataset and model.

    If none passes, all of them as a fall-back, by gap and score: `place` numbers the rows of a dataset.
    """
    s = composite_score(df)
    base = s.where("mitigation = 'baseline'").groupBy("dataset", "model_type").agg(F.min_by("score", "experiment_id").alias("baseline_score"))
    t = s.where("mitigation <> 'baseline' AND score IS NOT NULL").join(base, ["dataset", "model_type"], "left")
    drop = (F.col("baseline_score") - F.col("score")) / F.nullif(F.col("baseline_score"), F.lit(0.0))
    t = t.withColumns({"drop_pct": F.round(100 * drop, 4), "recall_tier": gate_recall(F.col("recall"), recall_floor, least_recall)})
    passes = F.coalesce((drop <= most_drop) & (F.col("gap") <= most_gap) & (F.col("recall_tier") != "fail"), F.lit(False))
    t = t.withColumn("_passes", passes)
    some = F.max("_passes").over(Window.partitionBy())
    t = t.withColumn("is_fallback", ~some).where(F.col("_passes") | F.col("is_fallback"))
    order = [F.when(F.col("is_fallback"), F.col("gap")).asc_nulls_last(), F.desc("score"), F.asc("experiment_id")]
    place = F.row_number().over(Window.partitionBy("dataset").orderBy(*order))
    return t.select("dataset", place.alias("place"), "experiment_id", "score", "baseline_score", "drop_pct", "recall_tier", "gap", "is_fallback")


def topk_models(df: DataFrame, k: int = 10) -> DataFrame:
    """The k experiments of best score, ranked; k is the report's size."""
    best = composite_score(df).where("score IS NOT NULL").orderBy(F.desc("score"), "experiment_id").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "experiment_id")).alias("rank"), "experiment_id", "score")


def best_per_strategy(gains: DataFrame, keys: list[str]) -> DataFrame:
    """The best mitigation for each of `keys` under the rule of tiers; all rows compete without keys."""
    w = Window.partitionBy(*keys).orderBy(*best_first())
    t = eligible(gains, keys).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return t.select(*keys, "tier", "experiment_id", "mitigation", "gap_gain", "recall_delta", "f1_delta")


def baseline_best_table(df: DataFrame) -> DataFrame:
    """The baseline of best F1 for each dataset and model."""
    order = F.struct("f1", F.struct(F.col("experiment_id")))
    t = df.where("mitigation = 'baseline'").groupBy("dataset", "model_type").agg(F.max_by(F.struct("experiment_id", "f1", "recall", "gap"), order).alias("b"))
    return t.select("dataset", "model_type", "b.*")


def intersectional_matrix(deltas: DataFrame, groups: list[str]) -> DataFrame:
    """Mean improvement of each mitigation and group, a column for each group."""
    t = deltas.groupBy("mitigation").pivot("grp", groups).agg(F.round(F.avg("improvement"), 9))
    return t.select("mitigation", *(F.col(f"`{g}`").alias(f"group_{g}") for g in groups))


def selected_group_rows(paired: DataFrame, selected: DataFrame) -> DataFrame:
    """Rows by group of the selected experiments that have both values."""
    both = paired.where("value IS NOT NULL AND baseline_value IS NOT NULL")
    return both.join(selected.select("experiment_id"), "experiment_id", "left_semi")


def group_improvement_mean(deltas: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean improvement of each group, and its mean values of `metrics` before and after."""
    of = lambda m, c: F.round(F.avg(F.when(F.col("metric") == m, F.col(c))), 9)
    sides = [of(m, c).alias(f"{m}_{n}") for m in metrics for c, n in (("baseline_value", "before"), ("value", "after"))]
    return deltas.groupBy("attr", "grp").agg(F.round(F.avg("improvement"), 9).alias("improvement"), *sides)


def experiment_list(df: DataFrame) -> DataFrame:
    """Experiments, the newest id first."""
    return df.select(F.row_number().over(Window.orderBy(F.desc("experiment_id"))).alias("place"), "experiment_id", "dataset", "model_type", "mitigation")


def join_plot_frame(index: DataFrame, values: DataFrame, deltas: DataFrame, metrics: list[str], changed: list[str]) -> DataFrame:
    """One row for each experiment: its index row, its values and its improvements as columns."""
    v = values.groupBy("experiment_id").pivot("metric", metrics).agg(F.first("value"))
    d = deltas.groupBy("experiment_id").pivot("metric", changed).agg(F.first("improvement"))
    d = d.withColumnsRenamed({m: f"{m}_improvement" for m in changed})
    return index.join(v, "experiment_id", "left").join(d, "experiment_id", "left")


def mit_table(df: DataFrame) -> DataFrame:
    """Mean gap and score of each dataset, model and mitigation, and what was gained on the baseline's mean gap."""
    keys = ["dataset", "model_type"]
    t = composite_score(df).groupBy(*keys, "mitigation").agg(F.round(F.avg("score"), 9).alias("mean_score"), F.round(F.avg("gap"), 9).alias("mean_gap"))
    base = t.where("mitigation = 'baseline'").select(*keys, F.col("mean_gap").alias("baseline_gap"))
    gain = F.col("baseline_gap") - F.col("mean_gap")
    return t.join(base, keys, "left").withColumns({"gain": F.round(gain, 6), "gain_pct": F.round(F.when(F.col("baseline_gap") > 0, 100 * gain / F.col("baseline_gap")), 4)})


def mit_rows(df: DataFrame, metrics: tuple[str, ...] = ("f1", "recall", "gap")) -> DataFrame:
    """A flat row for each mitigated experiment and metric: before, after, delta; a note where there is no baseline."""
    t = join_baseline(df).where("mitigation <> 'baseline'")
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"b.{m}").alias("before"), F.col(m).alias("after")) for m in metrics))
    rows = t.select("experiment_id", "mitigation", F.inline(each))
    return rows.withColumns({"delta": F.round(F.col("after") - F.col("before"), 6), "note": F.when(F.col("before").isNull(), "no baseline")})
