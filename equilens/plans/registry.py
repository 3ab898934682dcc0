"""The queries that are registered, by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.functions import scalars
from equilens.operators import binning as B
from equilens.operators import breaks as K
from equilens.operators import experiments as E
from equilens.operators import fairness as A
from equilens.operators import lineage as L
from equilens.operators import preparation as P
from equilens.operators import profiling as D
from equilens.operators import statistics as S
from equilens.plans import twins as W
from equilens.plans import auditing, describing, discovery, evidencing, grouping, harmonizing, modelling, searching
from equilens.sources.tables import twin, view

Query = Callable[[SparkSession, str], DataFrame]
GROUPS = ["grp_a", "grp_b"]
AGE = [-1000.0, 1000.0, 3000.0, 5000.0, 7500.0, 10000.0]
COARSE = [-1000.0, 2500.0, 10000.0]


def _on(name: str, op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(view(spark, sf_dir, name))


def _pair(op: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(view(spark, sf_dir, "v_lineage_a"), view(spark, sf_dir, "v_lineage_b"))


def _binned(df: DataFrame, edges: list[float] = AGE) -> DataFrame:
    return B.bin_apply(df, "age_raw", edges)


def _scalar_table(df: DataFrame) -> DataFrame:
    c = F.col
    return df.select(
        "doc_id", scalars.any_substring(c("lang"), ["e", "X"]).alias("has_e"), scalars.race_group(c("source")).alias("title"), scalars.clip(c("n_chars") / 1000).alias("clipped"),
        scalars.normalize_attr_name(F.concat("lang", F.lit("_cat"))).alias("attr"), scalars.safe_cast(F.regexp_replace("source", "src", "")).alias("source_no"), scalars.basename(F.concat(F.lit("a/b/"), "source")).alias("base"),
    )


def queries() -> dict[str, Query]:
    pred, exp, age, doc = (lambda op, n=n: _on(n, op) for n in ("v_pred", "v_exp", "v_age", "v_doc"))
    return {
        "all_fairness_metrics": pred(lambda d: A.fairness_metrics(d, GROUPS, list(A.METRICS))),
        "demographic_parity": pred(lambda d: A.fairness_metrics(d, GROUPS, ["demographic_parity"])),
        "equalized_odds": pred(lambda d: A.fairness_metrics(d, GROUPS, ["equalized_odds"])),
        "equal_opportunity": pred(lambda d: A.fairness_metrics(d, GROUPS, ["equal_opportunity"])),
        "predictive_parity": pred(lambda d: A.fairness_metrics(d, GROUPS, ["predictive_parity"])),
        "calibration_by_group": pred(lambda d: A.calibration_by_group(d, GROUPS)),
        "group_performance": pred(lambda d: A.group_performance(d, GROUPS)),
        "roc_auc": pred(lambda d: A.roc_auc(d, ["grp_b"])),
        "gated_fairness_report": _on("v_pred_gated", lambda d: A.gated_report(d, ["segment", "priority"])),
        "confusion_metrics": pred(lambda d: A.confusion_metrics(d, ["grp_a"])),
        "threshold_sweep": pred(A.threshold_sweep),
        "prediction_table": pred(lambda d: A.prediction_table(d).select("row_id", "y_pred", "confidence", "near_threshold")),
        "outcome_class": pred(lambda d: A.outcome_class(d).select("row_id", "outcome")),
        "missing_by_column": doc(D.missing_by_column),
        "missing_by_group": doc(lambda d: D.missing_by_group(d, "lang", ["quality", "toxic"])),
        "missing_rows": doc(D.missing_rows),
        "missing_cooccurrence": doc(lambda d: D.missing_cooccurrence(d, ["quality", "toxic", "lang"])),
        "duplicate_rows": _on("v_lineage_a", D.duplicate_rows),
        "duplicate_index_values": pred(lambda d: D.duplicate_index_values(d, ["row_id", "grp_a"])),
        "sensitive_distribution": doc(lambda d: D.sensitive_distribution(d, ["lang", "source", "toxic"])),
        "class_balance": doc(lambda d: D.class_balance(d, "quality")),
        "target_rate_by_group": _on("v_doc", lambda d: D.target_rate_by_group(d.withColumn("toxicity", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean")), "toxicity", "y_pred")),
        "group_statistics": _on("v_age", lambda d: D.group_statistics(d, "sex", "target")),
        "representation_balance": doc(lambda d: D.representation_balance(d, ["lang", "source"])),
        "label_imbalance": age(lambda d: D.label_imbalance(d, ["sex"], "target")),
        "column_profile": doc(D.column_profile),
        "semantic_type": doc(lambda d: D.semantic_type(D.column_profile(d))),
        "numeric_distribution": age(lambda d: D.numeric_distribution(d, ["age_raw"])),
        "numeric_histogram": doc(lambda d: D.histogram(d, "n_chars")),
        "categorical_distribution": doc(lambda d: D.categorical_distribution(d, "source")),
        "outlier_counts": doc(lambda d: D.outlier_counts(d, "lang", "n_chars")),
        "correlation_matrix": pred(lambda d: D.correlation(d, ["y_true", "y_proba", "y_pred"])),
        "crosstab_group": doc(lambda d: D.crosstab(d, "lang", "y_pred")),
        "dominant_category": doc(lambda d: D.dominant_category(d, ["lang", "source"])),
        "issue_flags": age(lambda d: D.issue_flags(d, ["sex"], "target")),
        "bin_fixed": age(lambda d: _binned(d).select("row_id", "bin")),
        "bin_stats": age(lambda d: B.bin_stats(_binned(d), "age_raw", "target")),
        "bin_fairness": age(lambda d: B.bin_fairness(_binned(d), "target")),
        "bin_disparity": age(lambda d: B.bin_disparity(_binned(d), "target")),
        "bin_sensitive_mix": age(lambda d: B.bin_sensitive_mix(_binned(d), "sex")),
        "bin_ordinal": age(lambda d: B.bin_ordinal(_binned(d), "age_raw")),
        "bin_compare_strategies": age(lambda d: B.bin_compare(d, "age_raw", "target", {"fine": AGE, "coarse": COARSE})),
        "bin_quantile": age(lambda d: B.bin_stats(_binned(d, B.quantile_edges(d, "age_raw", 4)), "age_raw", "target")),
        "bin_jenks": age(lambda d: K.jenks_edges(d, ["sex"], "age_raw", 4)),
        "bin_repair": age(lambda d: B.bin_stats(_binned(d, B.bin_repair(d, "age_raw", AGE, max(1, d.count() // 4))), "age_raw", "target")),
        "composite_score": exp(lambda d: E.composite_score(d).select("experiment_id", "score")),
        "gate_annotate": exp(lambda d: E.gate_annotate(d).select("experiment_id", "recall_gate", "fairness_gate")),
        "baseline_deltas": exp(E.baseline_deltas),
        "experiment_index": exp(E.experiment_index),
        "metric_values_long": exp(E.metric_values_long),
        "metric_deltas_long": exp(E.metric_deltas_long),
        "pareto_front": exp(E.pareto_front),
        "topk_tiered": exp(E.topk_tiered),
        "best_per_dataset": exp(lambda d: E.best_per(d, ["dataset"])),
        "best_per_model": exp(lambda d: E.best_per(d, ["dataset", "model_type"])),
        "summary_stats": exp(E.summary_stats),
        "pivot_binning": exp(lambda d: E.pivot_score(d, "binning", ["A", "N", "R"])),
        "pivot_mitigation": exp(lambda d: E.pivot_score(d, "mitigation", ["A", "N", "R"])),
        "mitigation_delta_matrix": exp(E.mitigation_delta_matrix),
        "rank_metric_difficulty": exp(lambda d: E.rank_metric_difficulty(d, "dataset", ["f1", "recall", "gap"])),
        "cv_fold_aggregate": exp(lambda d: E.cv_fold_aggregate(d, ["dataset"], ["f1", "gap"])),
        "multiset_overlap": _pair(L.multiset_overlap),
        "multiset_difference": _pair(L.multiset_difference),
        "union_lineage_audit": _pair(L.union_lineage_audit),
        "join_occurrence": _pair(L.occurrence_match),
        "set_overlap_matrix": lambda s, d: L.set_overlap_matrix(view(s, d, "v_lineage_a").withColumn("src", F.lit("a")).unionByName(view(s, d, "v_lineage_b").withColumn("src", F.lit("b"))), "src", ["k1", "k2", "k3"]),
        "dedup_keep_first": doc(lambda d: L.dedup_keep_first(d.select("doc_id", "lang", "source"), ["lang", "source"], ["doc_id"])),
        "test_chi2": doc(lambda d: S.chi_square(d, "lang", "y_pred")),
        "cramers_v": pred(lambda d: S.chi_square(d, "grp_a", "y_true")),
        "test_ks": _on("v_drift", lambda d: S.ks(d, "event_type", "value", "click", "view")),
        "test_mann_whitney": _on("v_drift", lambda d: S.mann_whitney(d, "event_type", "value", "click", "view")),
        "cx_f2_f3_f4": age(lambda d: S.complexity_f(d, ["age_raw"], "target")),
        "split_stratified": age(lambda d: P.split_stratified(d, "row_id", ["target", "sex"]).select("row_id", "split")),
        "split_grouped": _on("v_group", lambda d: P.split_grouped(d, "patient", "target").select("row_id", "split")),
        "split_group_stratified": _on("v_group", lambda d: P.split_group_stratified(d, "patient", "target").select("row_id", "split")),
        "folds_stratified": age(lambda d: P.folds_stratified(d, "row_id", ["target"]).select("row_id", "fold")),
        "scale_fit_apply": pred(lambda d: P.scale_fit_apply(d.select("row_id", "grp_a", "y_proba"), ["y_proba"], F.col("grp_a") == "F").select("row_id", F.round("y_proba", 6).alias("z"))),
        "impute_fit_apply": doc(lambda d: P.impute_fit_apply(d.select("doc_id", F.col("quality").cast("double").alias("quality"), "lang"), ["quality"], ["lang"], F.col("doc_id") % 2 == 0)),
        "sample_stable": age(lambda d: P.sample_stable(d, "row_id", 200).select("row_id", "target")),
        "sample_stratified": age(lambda d: P.sample_stratified(d, "row_id", "sex", 500).select("row_id", "sex")),
        "sample_near_threshold": pred(lambda d: P.sample_near_threshold(A.prediction_table(d), "row_id", 50).select("row_id", "y_proba")),
        "sample_cells": pred(lambda d: P.sample_cells(A.outcome_class(d), "row_id", GROUPS, 4, 100)),
        "mit_extend_sensitive": age(lambda d: P.extend_sensitive(d.where("row_id % 10 = 0").select("row_id"), d, "row_id", ["sex"]).select("row_id", "sex")),
        "encode_labels": doc(lambda d: P.encode_labels(d, d.where("lang IS NOT NULL").select("doc_id", "lang"), "lang")[1]),
        "impute_profile": doc(lambda d: P.impute_profile(d.select("doc_id", F.col("quality").cast("double").alias("quality"), "lang"), ["quality"], ["lang"])),
        "fold_preprocess": doc(lambda d: P.fold_preprocess(d.select("doc_id", "n_chars", "quality", (F.col("doc_id") % 3).alias("fold")), ["n_chars", "quality"], "fold", 3).select("fold_no", "side", "doc_id", F.round("n_chars", 6).alias("n_chars"), F.round("quality", 6).alias("quality"))),
        "mit_reweight": pred(lambda d: P.reweight(d, "y_true", "grp_b").groupBy("y_true", "grp_b").agg(F.count("*").alias("n"), F.round(F.max("weight"), 6).alias("weight"))),
        "mit_rus": age(lambda d: P.undersample(d, "row_id", "target").select("row_id", "target")),
        "mit_ros": age(lambda d: P.oversample(d, "row_id", "target").select("row_id", "target", "_copy")),
        "validity_constraints": doc(lambda d: P.validity_constraints(d, {"n_chars": {"least": 100, "most": 5000}, "quality": {"allow_null": False}}).select("doc_id", "n_chars", "quality")),
        "scalar_functions": doc(_scalar_table),
    } | discovery.queries() | modelling.queries() | harmonizing.queries() | auditing.queries() | evidencing.queries() | describing.queries() | grouping.queries() | searching.queries()


def _rates(where: str) -> str:
    """The twin of all rates, unpivoted by attribute and metric."""
    return f"""
WITH u AS (SELECT 'grp_a' AS attr, grp_a AS grp, y_true, y_pred FROM v_pred UNION ALL SELECT 'grp_b', grp_b, y_true, y_pred FROM v_pred),
c AS (SELECT attr, grp, count(*) AS n, sum(y_true * y_pred) AS tp, sum((1 - y_true) * y_pred) AS fp, sum((1 - y_true) * (1 - y_pred)) AS tn, sum(y_true * (1 - y_pred)) AS fn FROM u GROUP BY attr, grp),
r AS (SELECT attr, grp, n, 'positive_rate' AS metric, (tp + fp) / CAST(n AS DOUBLE) AS v FROM c
 UNION ALL SELECT attr, grp, n, 'tpr', CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END FROM c
 UNION ALL SELECT attr, grp, n, 'fpr', CASE WHEN fp + tn > 0 THEN fp / CAST(fp + tn AS DOUBLE) ELSE 0 END FROM c
 UNION ALL SELECT attr, grp, n, 'fnr', CASE WHEN tp + fn > 0 THEN fn / CAST(tp + fn AS DOUBLE) ELSE 0 END FROM c
 UNION ALL SELECT attr, grp, n, 'precision', CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END FROM c),
g AS (SELECT attr, metric, max(v) - min(v) AS gap FROM r GROUP BY attr, metric)
SELECT r.attr, r.metric, r.grp, round(r.v, 6) AS value, r.n, round(g.gap, 6) AS max_difference, round(g.gap, 9) < 0.1 AS is_fair FROM r JOIN g ON r.attr = g.attr AND r.metric = g.metric WHERE r.metric IN ({where})
"""


_BIN = "CASE WHEN age_raw >= -1000 AND age_raw <= 1000 THEN 0 WHEN age_raw > 1000 AND age_raw <= 3000 THEN 1 WHEN age_raw > 3000 AND age_raw <= 5000 THEN 2 WHEN age_raw > 5000 AND age_raw <= 7500 THEN 3 WHEN age_raw > 7500 AND age_raw <= 10000 THEN 4 END"
_BINNED = f"b AS (SELECT *, {_BIN} AS bin FROM v_age)"
_SCORE = "round(0.4 * f1 + 0.3 * recall + 0.2 * accuracy + 0.1 * auc, 6)"
_BASE = """j AS (SELECT e.*, coalesce(x.experiment_id, y.bid) AS bid, coalesce(x.f1, y.bf1) AS bf1, coalesce(x.recall, y.brecall) AS brecall, coalesce(x.gap, y.bgap) AS bgap,
 CASE WHEN x.experiment_id IS NOT NULL THEN 'exact' WHEN y.bid IS NOT NULL THEN 'no_variant' ELSE 'none' END AS src
 FROM v_exp e LEFT JOIN (SELECT * FROM v_exp WHERE mitigation = 'baseline') x ON e.dataset = x.dataset AND e.model_type = x.model_type AND e.binning = x.binning AND e.variant = x.variant
 LEFT JOIN (SELECT dataset, model_type, binning, min(experiment_id) AS bid, arg_min(f1, experiment_id) AS bf1, arg_min(recall, experiment_id) AS brecall, arg_min(gap, experiment_id) AS bgap FROM v_exp WHERE mitigation = 'baseline' GROUP BY 1, 2, 3) y
 ON e.dataset = y.dataset AND e.model_type = y.model_type AND e.binning = y.binning)"""
_COUNTS = "count(*) AS n, sum(y_true * y_pred) AS tp, sum((1 - y_true) * y_pred) AS fp, sum((1 - y_true) * (1 - y_pred)) AS tn, sum(y_true * (1 - y_pred)) AS fn"
_CONFUSION = "n, tp, fp, tn, fn, round((tp + tn) / CAST(n AS DOUBLE), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END, 6) AS f1"
_KEYS = "a.k1 IS NOT DISTINCT FROM b.k1 AND a.k2 IS NOT DISTINCT FROM b.k2 AND a.k3 IS NOT DISTINCT FROM b.k3"
_SIDES = "a AS (SELECT k1, k2, k3, count(*) AS n FROM v_lineage_a GROUP BY 1, 2, 3), b AS (SELECT k1, k2, k3, count(*) AS n FROM v_lineage_b GROUP BY 1, 2, 3)"


def oracle_sql() -> dict[str, str]:
    every = "'positive_rate', 'tpr', 'fpr', 'fnr', 'precision'"
    ranked = f"SELECT *, {_SCORE} AS score FROM v_exp"
    best = lambda keys: f"SELECT {keys}, experiment_id, score, gap FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, gap, experiment_id) AS r FROM ({ranked}) q) z WHERE r = 1"
    pivot = lambda rows: "SELECT " + rows + ", " + ", ".join(f"round(avg(CASE WHEN dataset = '{d}' THEN score END), 6) AS score_{d.lower()}" for d in "ANR") + f" FROM ({ranked}) q GROUP BY {rows}"
    doc_columns = ("doc_id", "lang", "source", "n_chars", "quality", "toxic", "y_pred")
    found = {
        "all_fairness_metrics": _rates(every),
        "demographic_parity": _rates("'positive_rate'"),
        "equalized_odds": _rates("'tpr', 'fpr', 'fnr'"),
        "equal_opportunity": _rates("'tpr'"),
        "predictive_parity": _rates("'precision'"),
        "calibration_by_group": """WITH u AS (SELECT 'grp_a' AS attr, grp_a AS grp, y_true, y_proba FROM v_pred UNION ALL SELECT 'grp_b', grp_b, y_true, y_proba FROM v_pred),
 p AS (SELECT attr, grp, least(floor(round(y_proba * 10, 9)), 9) AS bin, count(*) AS m, avg(y_proba) AS p, avg(y_true) AS y FROM u GROUP BY 1, 2, 3), e AS (SELECT attr, grp, sum(m * abs(p - y)) / sum(m) AS ece, CAST(sum(m) AS BIGINT) AS n FROM p GROUP BY 1, 2)
 SELECT attr, grp, round(ece, 6) AS ece, n, round(max(ece) OVER (PARTITION BY attr) - min(ece) OVER (PARTITION BY attr), 6) AS max_difference FROM e""",
        "roc_auc": """WITH s AS (SELECT grp_b, y_proba, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM v_pred GROUP BY 1, 2),
 w AS (SELECT grp_b, pos, neg, pos * (coalesce(sum(neg) OVER (PARTITION BY grp_b ORDER BY y_proba ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2.0) AS won FROM s)
 SELECT grp_b, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN CAST(sum(won) AS DOUBLE) / (sum(pos) * sum(neg)) END, 6) AS auc FROM w GROUP BY 1""",
        "group_performance": f"""WITH u AS (SELECT 'grp_a' AS attr, grp_a AS grp, y_true, y_pred, y_proba FROM v_pred UNION ALL SELECT 'grp_b', grp_b, y_true, y_pred, y_proba FROM v_pred), c AS (SELECT attr, grp, {_COUNTS} FROM u GROUP BY 1, 2),
 s AS (SELECT attr, grp, y_proba, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM u GROUP BY 1, 2, 3),
 w AS (SELECT attr, grp, pos, neg, pos * (coalesce(sum(neg) OVER (PARTITION BY attr, grp ORDER BY y_proba ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2.0) AS won FROM s),
 x AS (SELECT attr, grp, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN CAST(sum(won) AS DOUBLE) / (sum(pos) * sum(neg)) END, 6) AS auc FROM w GROUP BY 1, 2)
 SELECT c.attr, c.grp, n, round((tp + tn) / CAST(n AS DOUBLE), 6) AS accuracy, round(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 6) AS precision, round(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 6) AS recall, round(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 6) AS f1, round((tp + fn) / CAST(n AS DOUBLE), 6) AS prevalence, auc FROM c JOIN x ON c.attr = x.attr AND c.grp = x.grp""",
        "confusion_metrics": f"SELECT grp_a, {_CONFUSION} FROM (SELECT grp_a, {_COUNTS} FROM v_pred GROUP BY 1) q",
        "threshold_sweep": f"SELECT threshold, {_CONFUSION} FROM (SELECT threshold, {_COUNTS} FROM (SELECT y_true, threshold, CASE WHEN y_proba >= threshold THEN 1 ELSE 0 END AS y_pred FROM v_pred, (VALUES (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE)) t(threshold)) p GROUP BY 1) q",
        "prediction_table": "SELECT row_id, y_pred, round(abs(y_proba - 0.5), 6) AS confidence, round(abs(y_proba - 0.5), 9) < 0.1 AS near_threshold FROM v_pred",
        "outcome_class": "SELECT row_id, CASE WHEN y_true = 1 AND y_pred = 1 THEN 'TP' WHEN y_pred = 1 THEN 'FP' WHEN y_true = 0 THEN 'TN' ELSE 'FN' END AS outcome FROM v_pred",
        "missing_by_column": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 6) AS share FROM v_doc" for c in doc_columns),
        "missing_by_group": " UNION ALL ".join(f"SELECT lang AS grp, '{c}' AS \"column\", count(*) - count({c}) AS missing FROM v_doc GROUP BY 1" for c in ("quality", "toxic")),
        "missing_cooccurrence": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL) AS \"both\", round(count(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL) / CAST(count(*) AS DOUBLE), 6) AS share FROM v_doc" for a, b in (("quality", "toxic"), ("quality", "lang"), ("toxic", "lang"))),
        "duplicate_rows": "SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(n - 1) AS BIGINT) AS duplicates, round(sum(n - 1) / CAST(sum(n) AS DOUBLE), 4) AS share FROM (SELECT count(*) AS n FROM v_lineage_a GROUP BY k1, k2, k3) q",
        "duplicate_index_values": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) - count(DISTINCT {c}) AS repeated, count(DISTINCT {c}) AS \"distinct\" FROM v_pred" for c in ("row_id", "grp_a")),
        "sensitive_distribution": " UNION ALL ".join(f"SELECT '{c}' AS attr, CAST({c} AS VARCHAR) AS grp, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM v_doc) AS DOUBLE), 6) AS share FROM v_doc WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("lang", "source", "toxic")),
        "class_balance": "WITH c AS (SELECT coalesce(CAST(quality AS VARCHAR), 'missing') AS class, count(*) AS n FROM v_doc GROUP BY 1), r AS (SELECT max(n) / CAST(min(n) AS DOUBLE) AS r FROM c) SELECT class, n, round(r, 6) AS ratio, CASE WHEN r < 1.5 THEN 'balanced' WHEN r < 3 THEN 'mild' ELSE 'high' END AS label FROM c, r",
        "target_rate_by_group": "SELECT CASE WHEN toxic = 1 THEN 'toxic' WHEN toxic = 0 THEN 'clean' END AS grp, count(*) AS n, round(avg(y_pred), 6) AS rate FROM v_doc GROUP BY 1",
        "group_statistics": "SELECT sex AS grp, count(*) AS n, round(avg(target), 6) AS prevalence, count(*) FILTER (WHERE target = 1) AS positives, count(*) FILTER (WHERE target = 0) AS negatives, round(count(*) / CAST((SELECT count(*) FROM v_age) AS DOUBLE), 6) AS share FROM v_age WHERE sex IS NOT NULL GROUP BY 1",
        "label_imbalance": "SELECT 'sex' AS attr, round(max(r) - min(r), 6) AS max_difference, round(CASE WHEN min(r) > 0 THEN max(r) / min(r) END, 6) AS max_ratio FROM (SELECT sex, avg(target) AS r FROM v_age WHERE sex IS NOT NULL GROUP BY 1) q",
        "crosstab_group": "SELECT lang AS a, y_pred AS b, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY lang) AS BIGINT) AS total, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY lang) AS DOUBLE), 6) AS share FROM v_doc GROUP BY 1, 2",
        "bin_fixed": f"WITH {_BINNED} SELECT row_id, bin FROM b",
        "bin_stats": f"WITH {_BINNED} SELECT bin, count(*) AS n, round(avg(target), 6) AS rate, min(age_raw) AS low, max(age_raw) AS high, round(count(*) / CAST((SELECT count(*) FROM v_age) AS DOUBLE), 6) AS share FROM b WHERE bin IS NOT NULL GROUP BY 1",
        "bin_sensitive_mix": f"WITH {_BINNED} SELECT bin, sex AS value, count(*) AS n, round(100 * count(*) / CAST(sum(count(*)) OVER (PARTITION BY bin) AS DOUBLE), 4) AS pct FROM b WHERE bin IS NOT NULL GROUP BY 1, 2",
        "bin_ordinal": f"WITH {_BINNED}, m AS (SELECT bin, avg(age_raw) AS mean FROM b WHERE bin IS NOT NULL GROUP BY 1) SELECT bin, CAST(dense_rank() OVER (ORDER BY mean) AS INTEGER) AS ordinal FROM m",
        "composite_score": f"SELECT experiment_id, {_SCORE} AS score FROM v_exp",
        "gate_annotate": "SELECT experiment_id, CASE WHEN recall IS NULL OR recall < 0.6 THEN 'fail' WHEN recall < 0.7 THEN 'lower_tier' ELSE 'full_pass' END AS recall_gate, CASE WHEN gap > 0.1 THEN 'fail' ELSE 'pass' END AS fairness_gate FROM v_exp",
        "baseline_deltas": f"WITH {_BASE} SELECT experiment_id, bid AS baseline_id, src AS baseline_source, round(f1 - bf1, 6) AS f1_delta, round(recall - brecall, 6) AS recall_delta, round(gap - bgap, 6) AS gap_delta, round(CASE WHEN bgap > 0 THEN 100 * (bgap - gap) / bgap END, 4) AS gain_pct FROM j WHERE mitigation <> 'baseline'",
        "experiment_index": f"WITH {_BASE} SELECT experiment_id, bid AS baseline_id, src AS baseline_source FROM j",
        "metric_values_long": " UNION ALL ".join(f"SELECT experiment_id, '{m}' AS metric, {m} AS value FROM v_exp WHERE {m} IS NOT NULL" for m in ("f1", "recall", "accuracy", "auc", "gap")),
        "metric_deltas_long": f"WITH {_BASE} " + " UNION ALL ".join(f"SELECT experiment_id, '{m}' AS metric, round({m} - b{m}, 6) AS delta, round({'-' if m == 'gap' else ''}({m} - b{m}), 6) AS improvement FROM j WHERE mitigation <> 'baseline' AND {m} - b{m} IS NOT NULL" for m in ("f1", "recall", "gap")),
        "pareto_front": f"WITH s AS ({ranked}) SELECT dataset, experiment_id, score, gap FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.dataset = s.dataset AND ((o.score > s.score AND o.gap <= s.gap) OR (o.score >= s.score AND o.gap < s.gap)))",
        "best_per_dataset": best("dataset"),
        "best_per_model": best("dataset, model_type"),
        "summary_stats": "SELECT mitigation, count(*) AS n, " + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std, min({m}) AS {m}_min, max({m}) AS {m}_max" for m in ("f1", "recall", "gap")) + " FROM v_exp GROUP BY 1",
        "pivot_binning": pivot("binning"),
        "pivot_mitigation": pivot("mitigation"),
        "mitigation_delta_matrix": f"WITH {_BASE} SELECT mitigation, round(avg(f1 - bf1), 6) AS f1_delta, round(avg(recall - brecall), 6) AS recall_delta, round(avg(gap - bgap), 6) AS gap_delta FROM j WHERE mitigation <> 'baseline' GROUP BY 1",
        "cv_fold_aggregate": " UNION ALL ".join(f"SELECT dataset, '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std, min({m}) AS min, max({m}) AS max, count({m}) AS folds FROM v_exp GROUP BY 1" for m in ("f1", "gap")),
        "multiset_overlap": f"WITH {_SIDES}, o AS (SELECT coalesce(sum(least(a.n, b.n)), 0) AS o FROM a JOIN b ON {_KEYS}), s AS (SELECT (SELECT sum(n) FROM a) AS x, (SELECT sum(n) FROM b) AS y) SELECT CAST(o AS BIGINT) AS overlap, CAST(x AS BIGINT) AS rows_a, CAST(y AS BIGINT) AS rows_b, round(100 * o / CAST(x AS DOUBLE), 4) AS pct_a, round(100 * o / CAST(y AS DOUBLE), 4) AS pct_b FROM o, s",
        "multiset_difference": f"WITH {_SIDES}, d AS (SELECT coalesce(a.k1, b.k1) AS k1, coalesce(a.k2, b.k2) AS k2, coalesce(a.k3, b.k3) AS k3, coalesce(a.n, 0) - coalesce(b.n, 0) AS d FROM a FULL OUTER JOIN b ON {_KEYS}) SELECT k1, k2, k3, abs(d) AS n, CASE WHEN d > 0 THEN 'missing' ELSE 'unexpected' END AS side FROM d WHERE d <> 0",
        "union_lineage_audit": f"WITH {_SIDES} SELECT count(*) AS n_union, count(*) FILTER (WHERE a.n IS NOT NULL AND b.n IS NOT NULL) AS n_both, count(*) FILTER (WHERE b.n IS NULL) AS only_a, count(*) FILTER (WHERE a.n IS NULL) AS only_b FROM a FULL OUTER JOIN b ON {_KEYS}",
        "join_occurrence": f"WITH {_SIDES}, d AS (SELECT coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL OUTER JOIN b ON {_KEYS}) SELECT side, CAST(n AS BIGINT) AS n FROM (SELECT 'both' AS side, sum(least(x, y)) AS n FROM d UNION ALL SELECT 'left_only', sum(greatest(x - y, 0)) FROM d UNION ALL SELECT 'right_only', sum(greatest(y - x, 0)) FROM d) q WHERE n > 0",
        "dedup_keep_first": "SELECT min(doc_id) AS doc_id, lang, source FROM v_doc GROUP BY lang, source",
        "scale_fit_apply": "SELECT row_id, round((y_proba - m) / s, 6) AS z FROM v_pred, (SELECT avg(y_proba) AS m, stddev_pop(y_proba) AS s FROM v_pred WHERE grp_a = 'F') q",
        "mit_reweight": "WITH c AS (SELECT y_true, grp_b, count(*) AS n FROM v_pred GROUP BY 1, 2) SELECT y_true, grp_b, n, round((SELECT sum(n) FROM c) / CAST((SELECT count(*) FROM c) * n AS DOUBLE), 6) AS weight FROM c",
        "validity_constraints": "SELECT doc_id, n_chars, quality FROM v_doc WHERE NOT coalesce(n_chars < 100 OR n_chars > 5000, false) AND quality IS NOT NULL",
    }
    return {k: twin(v) for k, v in (found | W.oracle_sql() | discovery.oracle_sql() | modelling.oracle_sql() | harmonizing.oracle_sql() | auditing.oracle_sql() | evidencing.oracle_sql() | describing.oracle_sql() | grouping.oracle_sql() | searching.oracle_sql()).items()}
