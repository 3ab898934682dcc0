"""Queries that audit whole runs, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.operators import audit as U
from equilens.operators import experiments as E
from equilens.operators import fairness as A
from equilens.operators import harmonize as H
from equilens.sources.tables import view

Query = Callable[[SparkSession, str], DataFrame]
ATTRS = ["line", "part"]
RUN = ["dataset", "model", "split"]
KINDS = ["demographic_parity", "equalized_odds", "predictive_parity"]


def _views(df: DataFrame) -> DataFrame:
    """Predictions with coded groups, as the group views need them."""
    coded = df.select(
        "y_true", "y_pred", (F.col("small") % 3 - 1).cast("int").alias("sex"),
        F.element_at(F.array(*map(F.lit, ("<20", "20-39", "40-59", "80+", "unknown"))), (F.col("small") % 5 + 1).cast("int")).alias("age_group"),
        F.element_at(F.array(*map(F.lit, ("I-II", "III-IV", "V-VI", "unknown"))), (F.col("small") % 4 + 1).cast("int")).alias("fitzpatrick_group"),
    )
    return H.derive_group_views(coded)


def _risk(df: DataFrame) -> DataFrame:
    perf = A.confusion_metrics(df, RUN)
    return E.overfit_gap(perf.where("split = 'train'"), perf.where("split = 'test'"), ["dataset", "model"])


def _recorded(df: DataFrame) -> DataFrame:
    """Scores of one group are its hard labels, and every second group has lost its AUC."""
    scores = df.withColumn("y_proba", F.when(F.col("grp_b") == "4", F.col("y_pred").cast("double")).otherwise(F.col("y_proba")))
    no = F.col("grp_b").cast("int")
    recorded = df.select("grp_b").distinct().select("grp_b", F.when(no % 2 == 0, 0.0).when(no < 7, 0.7).alias("auc"))
    return U.auc_repair(recorded, scores, "grp_b")


def _attributions(df: DataFrame) -> DataFrame:
    pairs = F.array(F.struct(F.lit("score").alias("feature"), (F.col("y_proba") - 0.5).alias("value")), F.struct(F.lit("label").alias("feature"), (F.col("y_true") - F.col("y_proba")).alias("value")))
    return df.select("grp_b", F.inline(pairs))


def queries() -> dict[str, Query]:
    def on(name: str, op: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: op(view(spark, sf_dir, name))

    runs, pred = (lambda op, n=n: on(n, op) for n in ("v_runs", "v_pred"))
    return {
        "fairness_summary": runs(lambda d: U.fairness_summary(d, ATTRS, KINDS)),
        "group_support_partition": runs(lambda d: U.group_support(d, ["small"], 640)),
        "degenerate_groups": runs(lambda d: U.degenerate_groups(d.withColumn("y_true", F.when(F.col("line") == "3", 0).when(F.col("line") == "5", 1).otherwise(F.col("y_true"))), ["line"])),
        "gated_fairness_runs": runs(lambda d: A.gated_report(d, ATTRS, 50, RUN)),
        "group_view_report": runs(lambda d: U.group_view_report(_views(d))),
        "subgroup_rows": runs(lambda d: U.subgroup_rows(d, ATTRS, RUN)),
        "assess_run": runs(lambda d: U.assess_run(d, ATTRS, RUN)),
        "train_test_gap": runs(lambda d: U.train_test_gap(U.assess_run(d, ATTRS, RUN), ["dataset", "model"])),
        "fairness_by_cluster": runs(lambda d: U.fairness_by_cluster(d, "cluster", ATTRS)),
        "per_group_flatten": runs(lambda d: U.per_group_flatten(d, ATTRS, ["dataset"])),
        "fairness_gap_dp": runs(lambda d: U.fairness_gaps(d, ATTRS, RUN).select(*RUN, "gap_dp")),
        "fairness_gap_full": runs(lambda d: U.fairness_gaps(d, ATTRS, RUN).select(*RUN, "gap_full")),
        "model_compare_rows": runs(lambda d: U.model_compare_rows(d.where("split = 'test'"), ATTRS, ["dataset", "model"])),
        "overfit_gap": runs(_risk),
        "overfit_flag": runs(lambda d: A.confusion_metrics(d, RUN).select(*RUN, U.overfit_flag(F.lit(None).cast("double"), F.col("f1") + 0.5, F.col("accuracy") + 0.5).alias("flag"))),
        "join_overfit_risk": runs(lambda d: E.join_overfit_risk(A.confusion_metrics(d.where("split = 'test'"), ["dataset", "model"]).select("dataset", "model", "f1"), _risk(d.where("model = 'F'")), ["dataset", "model"])),
        "auc_repair": pred(_recorded),
        "shap_aggregate": pred(lambda d: U.shap_aggregate(_attributions(d))),
        "shap_dataset_summary": pred(lambda d: U.shap_dataset_summary(U.shap_aggregate(_attributions(d), ["grp_b"]))),
        "lime_collect": pred(lambda d: U.collect_folds({i: _attributions(d.where(F.col("grp_a") == g)).groupBy("feature").agg(F.round(F.sum("value"), 4).alias("weight")) for i, g in enumerate(("F", "O"))})),
    }


_COUNTS = "count(*) AS n, sum(y_true * y_pred) AS tp, sum((1 - y_true) * y_pred) AS fp, sum((1 - y_true) * (1 - y_pred)) AS tn, sum(y_true * (1 - y_pred)) AS fn"
_RATES = """
CAST(tp + fp AS DOUBLE) / n AS positive_rate, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS tpr,
  CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / (fp + tn) ELSE 0 END AS fpr, CASE WHEN tp + fn > 0 THEN CAST(fn AS DOUBLE) / (tp + fn) ELSE 0 END AS fnr,
  CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS "precision\""""
_NAMES = ("positive_rate", "tpr", "fpr", "fnr", "precision")


def _table(keys: str = "", attrs: tuple[str, ...] = ("line", "part"), source: str = "v_runs") -> str:
    """CTEs u (a row for each attribute), c (counts of groups) and r (their rates), by `keys`."""
    k = f"{keys}, " if keys else ""
    u = " UNION ALL ".join(f"SELECT {k}'{a}' AS attr, CAST({a} AS VARCHAR) AS grp, y_true, y_pred, y_proba FROM {source}" for a in attrs)
    return f"u AS ({u}), c AS (SELECT {k}attr, grp, {_COUNTS} FROM u GROUP BY ALL), r AS (SELECT *, {_RATES} FROM c)"


def _long(keys: str = "", names: tuple[str, ...] = _NAMES) -> str:
    """CTE l: (keys, attr, metric, gap)."""
    k = f"{keys}, " if keys else ""
    return "l AS (" + " UNION ALL ".join(f"SELECT {k}attr, '{m}' AS metric, max(\"{m}\") - min(\"{m}\") AS gap, count(*) AS groups FROM r GROUP BY ALL" for m in names) + ")"


def _gated(keys: str, least: str = "50") -> str:
    """CTE s: groups with their status and the gaps of the compared ones."""
    over = f"OVER (PARTITION BY {keys + ', ' if keys else ''}attr)"
    gap = lambda m: f"CASE WHEN count(*) FILTER (WHERE status = 'compared') {over} >= 2 THEN round(max({m}) FILTER (WHERE status = 'compared') {over} - min({m}) FILTER (WHERE status = 'compared') {over}, 6) END"
    return f"""
s AS (
  SELECT *, {gap('positive_rate')} AS dp_gap, {gap('tpr')} AS tpr_gap, {gap('fpr')} AS fpr_gap
  FROM (SELECT *, CASE WHEN n < {least} THEN 'undersized' WHEN tp + fn = 0 OR fp + tn = 0 THEN 'degenerate'
    WHEN lower(grp) = 'unknown' OR lower(grp) LIKE '% x unknown' OR lower(grp) LIKE 'unknown x %' THEN 'unknown' ELSE 'compared' END AS status FROM r) q)"""


_SHOWN = "attr, grp, n, status, round(positive_rate, 6) AS positive_rate, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, dp_gap, tpr_gap, fpr_gap"
_RUN = "dataset, model, split"
_PERF = """
p AS (
  SELECT dataset, model, split, round(CAST(tp + tn AS DOUBLE) / n, 6) AS accuracy, round(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1
  FROM (SELECT dataset, model, split, count(*) AS n, sum(y_true * y_pred) AS tp, sum((1 - y_true) * y_pred) AS fp, sum((1 - y_true) * (1 - y_pred)) AS tn, sum(y_true * (1 - y_pred)) AS fn FROM v_runs GROUP BY ALL) c)"""
_RISK = """
k AS (
  SELECT a.dataset, a.model, round(a.f1 - b.f1, 4) AS f1_gap, round(a.accuracy - b.accuracy, 4) AS acc_gap,
    CASE WHEN a.f1 >= 0.98 OR a.f1 - b.f1 >= 0.15 OR a.accuracy >= 0.99 THEN 'high' WHEN a.f1 - b.f1 >= 0.08 OR a.accuracy - b.accuracy >= 0.08 THEN 'medium' ELSE 'low' END AS risk
  FROM p a JOIN p b ON a.dataset = b.dataset AND a.model = b.model AND a.split = 'train' AND b.split = 'test')"""
_AUC = """
s AS (SELECT {keys}, y_proba, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM {source} GROUP BY ALL),
w AS (SELECT *, pos * (coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY y_proba ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2.0) AS won FROM s),
x AS (SELECT {keys}, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN CAST(sum(won) AS DOUBLE) / (sum(pos) * sum(neg)) END, 6) AS auc FROM w GROUP BY ALL)"""
_ATTR = "a AS (SELECT grp_b, 'score' AS feature, y_proba - 0.5 AS value FROM v_pred UNION ALL SELECT grp_b, 'label', y_true - y_proba FROM v_pred)"
_SHAP = "round(avg(abs(value)), 6) AS mean, round(stddev_pop(abs(value)), 6) AS std, " + ", ".join(f"round(quantile_cont(abs(value), {q}), 6) AS {n}" for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")))
_CODED = """
d AS (
  SELECT y_true, y_pred, y_proba, CASE small % 3 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Female' ELSE 'Male' END AS sex_view,
    CASE small % 5 WHEN 0 THEN '<40' WHEN 1 THEN '<40' WHEN 2 THEN '40-59' WHEN 3 THEN '60+' ELSE 'Unknown' END AS age_coarse,
    CASE small % 4 WHEN 0 THEN 'I-II' WHEN 1 THEN 'III-IV' WHEN 2 THEN 'V-VI' ELSE 'unknown' END AS skin_view
  FROM v_runs),
e AS (SELECT *, sex_view || ' x ' || skin_view AS sex_x_skin, age_coarse || ' x ' || skin_view AS age_x_skin FROM d)"""


def oracle_sql() -> dict[str, str]:
    views = ("age_coarse", "sex_view", "skin_view", "sex_x_skin", "age_x_skin")
    run = f"WITH {_table(_RUN)}, {_long(_RUN)}"
    return {
        "fairness_summary": f"WITH {_table()}, {_long()} SELECT attr, metric, round(gap, 6) AS max_difference, round(gap, 9) < 0.1 AS is_fair, groups FROM l",
        "group_support_partition": "SELECT 'small' AS attr, CAST(small AS VARCHAR) AS grp, count(*) AS n, count(*) >= 640 AS kept FROM v_runs GROUP BY 2",
        "degenerate_groups": "SELECT 'line' AS attr, line AS grp, count(*) AS n, CASE line WHEN '3' THEN 'no_positives' ELSE 'no_negatives' END AS reason FROM v_runs WHERE line IN ('3', '5') GROUP BY 2, 4",
        "gated_fairness_runs": f"WITH {_table(_RUN)}, {_gated(_RUN)} SELECT {_RUN}, {_SHOWN} FROM s",
        "group_view_report": f"""
WITH {_CODED}, {_table(attrs=views, source="e")}, {_gated("", "CASE WHEN attr IN ('sex_x_skin', 'age_x_skin') THEN 30 ELSE 50 END")}
SELECT {_SHOWN}, attr IN ('sex_x_skin', 'age_x_skin') AS exploratory FROM s""",
        "subgroup_rows": f"""
WITH {_table(_RUN)}, {_gated(_RUN)}, {_AUC.replace("s AS", "y AS").replace("FROM s)", "FROM y)").format(keys=_RUN + ", attr, grp", source="u")}
SELECT {_RUN}, attr, grp, n, round(CAST(tp + fn AS DOUBLE) / n, 6) AS prevalence, round(CAST(tp + tn AS DOUBLE) / n, 6) AS accuracy, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall, auc,
  dp_gap, tpr_gap, fpr_gap, status = 'degenerate' AS degenerate, status = 'unknown' AS policy_excluded
FROM s JOIN x USING ({_RUN}, attr, grp)""",
        "assess_run": f"{run} SELECT {_RUN}, attr, metric, round(gap, 6) AS max_difference, round(gap, 9) < 0.1 AS is_fair FROM l",
        "train_test_gap": f"""
{run}
SELECT dataset, model, attr, metric, train_difference, test_difference, round(test_difference - train_difference, 6) AS delta
FROM (SELECT dataset, model, attr, metric, round(max(gap) FILTER (WHERE split = 'train'), 6) AS train_difference, round(max(gap) FILTER (WHERE split = 'test'), 6) AS test_difference FROM l GROUP BY ALL) g
WHERE train_difference IS NOT NULL AND test_difference IS NOT NULL""",
        "fairness_by_cluster": f"""
WITH {_table("cluster")}, g AS (SELECT cluster, attr, max(positive_rate) - min(positive_rate) AS dp, max(tpr) - min(tpr) AS tpr, max(fpr) - min(fpr) AS fpr FROM r GROUP BY ALL)
SELECT cluster, attr, round_even(dp, 4) AS dp_max_diff, round_even(tpr, 4) AS eo_tpr_diff, round_even(fpr, 4) AS eo_fpr_diff, n_samples, round(greatest(dp, tpr, fpr), 9) <= 0.1 AS is_fair
FROM g JOIN (SELECT cluster, count(*) AS n_samples FROM v_runs GROUP BY 1 HAVING count(*) >= 50) n USING (cluster)""",
        "per_group_flatten": f"""
WITH {_table("dataset")}, t AS (SELECT dataset, attr, sum(n) AS n, sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM c GROUP BY ALL), o AS (SELECT *, {_RATES} FROM t)
"""
        + " UNION ALL ".join(
            f"""SELECT dataset, attr, grp, '{m}' AS metric, round(r."{m}", 6) AS value, round(o."{m}", 6) AS overall, r.n, r.tp + r.fn AS positives, r.fp + r.tn AS negatives FROM r JOIN o USING (dataset, attr)""" for m in _NAMES
        ),
        "fairness_gap_dp": f"{run} SELECT {_RUN}, round(max(gap) FILTER (WHERE metric = 'positive_rate'), 6) AS gap_dp FROM l GROUP BY ALL",
        "fairness_gap_full": f"{run} SELECT {_RUN}, round(max(gap) FILTER (WHERE metric IN ('positive_rate', 'tpr', 'fpr')), 6) AS gap_full FROM l GROUP BY ALL",
        "model_compare_rows": f"""
WITH t AS (SELECT * FROM v_runs WHERE split = 'test'), {_table("dataset, model", source="t")}, {_long("dataset, model", ("positive_rate", "tpr", "fpr"))},
f AS (SELECT dataset, model, {_COUNTS} FROM t GROUP BY ALL), h AS (SELECT *, {_RATES} FROM f)
SELECT dataset, model, n, round(CAST(tp + tn AS DOUBLE) / n, 6) AS accuracy, round("precision", 6) AS "precision", round(tpr, 6) AS recall,
  round(CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn), 6) AS f1, dp_gap, tpr_gap, fpr_gap
FROM h JOIN (SELECT dataset, model, round(max(gap) FILTER (WHERE metric = 'positive_rate'), 6) AS dp_gap, round(max(gap) FILTER (WHERE metric = 'tpr'), 6) AS tpr_gap,
  round(max(gap) FILTER (WHERE metric = 'fpr'), 6) AS fpr_gap FROM l GROUP BY ALL) g USING (dataset, model)""",
        "overfit_gap": f"WITH {_PERF}, {_RISK} SELECT * FROM k",
        "overfit_flag": f"WITH {_PERF} SELECT {_RUN}, f1 + 0.5 >= 0.98 OR accuracy + 0.5 >= 0.99 AS flag FROM p",
        "join_overfit_risk": f"WITH {_PERF}, {_RISK} SELECT p.dataset, p.model, p.f1, f1_gap, acc_gap, risk FROM p LEFT JOIN (SELECT * FROM k WHERE model = 'F') k ON p.dataset = k.dataset AND p.model = k.model WHERE split = 'test'",
        "auc_repair": f"""
WITH {_AUC.format(keys="grp_b", source="v_pred")}, q AS (SELECT grp_b, CASE WHEN grp_b IN ('2', '6') THEN auc WHEN grp_b IN ('1', '3', '5') THEN 0.7 END AS auc FROM x)
SELECT grp_b, auc, grp_b IN ('2', '6') AS repaired, CASE WHEN auc IS NULL THEN 'missing_probability_scores' END AS reason FROM q""",
        "shap_aggregate": f"WITH {_ATTR} SELECT feature, {_SHAP} FROM a GROUP BY 1",
        "shap_dataset_summary": f"""
WITH {_ATTR}, b AS (SELECT grp_b, feature, {_SHAP} FROM a GROUP BY 1, 2)
SELECT feature, count(*) AS runs, round(avg(mean), 6) AS mean, round(stddev_samp(mean), 6) AS std, min(mean) AS min, max(mean) AS max,
  round(quantile_cont(mean, 0.25), 6) AS q1, round(quantile_cont(mean, 0.5), 6) AS median, round(quantile_cont(mean, 0.75), 6) AS q3
FROM b GROUP BY 1""",
        "lime_collect": """
SELECT feature, round(sum(value), 4) AS weight, fold
FROM (SELECT 'score' AS feature, y_proba - 0.5 AS value, CASE grp_a WHEN 'F' THEN 0 ELSE 1 END AS fold FROM v_pred UNION ALL SELECT 'label', y_true - y_proba, CASE grp_a WHEN 'F' THEN 0 ELSE 1 END FROM v_pred) a
GROUP BY ALL""",
    }
