"""Queries over evidence of mitigation, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.operators import evidence as V
from equilens.operators import experiments as E
from equilens.sources.tables import view

Query = Callable[[SparkSession, str], DataFrame]
GROUPS = ["0", "1", "2", "3"]


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of groups with their baselines. Some baselines are left out, so that every rule is needed."""
    values = view(spark, sf_dir, "v_group_values")
    baselines = values.where("mitigation = 'baseline' AND dataset <> 'N' AND (binning <> '2' OR variant = '0')")
    assessed = values.where("mitigation = 'baseline'").groupBy("dataset", "model_type", "attr", "grp", "metric").agg(F.max("value").alias("value"), F.max("overall").alias("overall"))
    return V.join_baseline_per_group(values, baselines, assessed)


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.group_metric_deltas(_paired(spark, sf_dir))


def _flags(df: DataFrame) -> DataFrame:
    """Whether an experiment's weights were applied: models of variant 1 reject them, mitigation m3 has none."""
    return df.select("experiment_id", F.when(F.col("mitigation") != "m3", F.col("variant") == "0").alias("weight_applied"))


def _evidence(keys: list[str], where: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = view(spark, sf_dir, "v_exp")
        found = V.evidence(V.with_gains(df.where(where)), _deltas(spark, sf_dir), keys)
        return V.degraded(found, _flags(df)) if "model_type" in keys else found

    return run


def _plot_frame(df: DataFrame) -> DataFrame:
    return V.join_plot_frame(E.experiment_index(df), E.metric_values_long(df), E.metric_deltas_long(df), ["f1", "recall", "gap"], ["recall", "gap"])


def _gains(df: DataFrame) -> DataFrame:
    return V.with_gains(df).where("model_type = 'F'")


def queries() -> dict[str, Query]:
    def on(op: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: op(view(spark, sf_dir, "v_exp"))

    paired = ["experiment_id", "attr", "grp", "metric", "baseline_id", "baseline_source", "value", "baseline_value", "baseline_overall"]
    return {
        "group_metric_values": lambda s, d: V.group_metric_values(view(s, d, "v_group_values")).select("experiment_id", "attr", "grp", "metric", "value", "overall", "higher_is_better"),
        "join_baseline_per_group": lambda s, d: _paired(s, d).select(*paired),
        "group_metric_deltas": lambda s, d: _deltas(s, d).select("experiment_id", "attr", "grp", "metric", "delta", "improvement", "distance_improvement"),
        "evidence_summary": _evidence(["dataset"], "model_type = 'F' AND dataset = 'R'"),
        "evidence_by_model": _evidence(["model_type"], "dataset <> 'N'"),
        "degraded_warnings": on(lambda d: V.degraded_warnings(V.degraded(d, _flags(d)))),
        "gated_best": on(lambda d: V.gated_best(d, 0.4, 0.5, 0.42)),
        "gated_best_fallback": on(lambda d: V.gated_best(d, 0.9, 0.95, 0.1)),
        "topk_models": on(V.topk_models),
        "best_per_strategy": on(lambda d: V.best_per_strategy(_gains(d), ["binning"])),
        "primary_row": on(lambda d: V.best_per_strategy(_gains(d), [])),
        "baseline_best_table": on(V.baseline_best_table),
        "intersectional_matrix": lambda s, d: V.intersectional_matrix(_deltas(s, d), GROUPS),
        "selected_group_rows": lambda s, d: V.selected_group_rows(_paired(s, d), E.best_per(view(s, d, "v_exp").where("mitigation <> 'baseline'"), ["dataset"])).select("experiment_id", "grp", "metric", "value", "baseline_value"),
        "group_improvement_mean": lambda s, d: V.group_improvement_mean(_deltas(s, d), ["tpr", "fpr"]),
        "experiment_list": on(V.experiment_list),
        "join_plot_frame": on(_plot_frame),
        "mit_table": on(V.mit_table),
        "mit_rows": on(V.mit_rows),
    }


_SCORE = "round(0.4 * f1 + 0.3 * recall + 0.2 * accuracy + 0.1 * auc, 6)"
_PAIRED = """
bl AS (SELECT * FROM v_group_values WHERE mitigation = 'baseline' AND dataset <> 'N' AND (binning <> '2' OR variant = '0')),
ex AS (SELECT dataset, model_type, binning, variant, max(experiment_id) AS e FROM bl GROUP BY ALL),
fi AS (SELECT dataset, model_type, binning, min(experiment_id) AS f FROM bl GROUP BY ALL),
se AS (SELECT dataset, model_type, grp, metric, max(value) AS value, max(overall) AS overall FROM v_group_values WHERE mitigation = 'baseline' GROUP BY ALL),
pr AS (
  SELECT v.experiment_id, v.mitigation, 'shift' AS attr, v.grp, v.metric, v.value, v.overall, coalesce(e, f) AS baseline_id,
    CASE WHEN e IS NOT NULL THEN 'exact' WHEN f IS NOT NULL THEN 'no_variant' ELSE 'assessment' END AS baseline_source,
    CASE WHEN coalesce(e, f) IS NULL THEN se.value ELSE bl.value END AS baseline_value, CASE WHEN coalesce(e, f) IS NULL THEN se.overall ELSE bl.overall END AS baseline_overall
  FROM v_group_values v LEFT JOIN ex USING (dataset, model_type, binning, variant) LEFT JOIN fi USING (dataset, model_type, binning)
    LEFT JOIN bl ON bl.experiment_id = coalesce(e, f) AND bl.grp = v.grp AND bl.metric = v.metric
    LEFT JOIN se ON se.dataset = v.dataset AND se.model_type = v.model_type AND se.grp = v.grp AND se.metric = v.metric)"""
_DELTAS = f"""{_PAIRED},
de AS (
  SELECT *, round(value - baseline_value, 6) AS delta,
    round(CASE metric WHEN 'demographic_parity_rate' THEN abs(baseline_value - baseline_overall) - abs(value - overall) WHEN 'fpr' THEN baseline_value - value ELSE value - baseline_value END, 6) AS improvement,
    round(CASE metric WHEN 'demographic_parity_rate' THEN abs(baseline_value - baseline_overall) - abs(value - overall) END, 6) AS distance_improvement
  FROM pr WHERE mitigation <> 'baseline' AND baseline_value IS NOT NULL)"""
_GAINS = """
ga AS (
  SELECT e.*, round(b.gap - e.gap, 6) AS gap_gain, round(e.recall - b.recall, 6) AS recall_delta, round(e.f1 - b.f1, 6) AS f1_delta
  FROM v_exp e LEFT JOIN (SELECT * FROM v_exp WHERE mitigation = 'baseline') b USING (dataset, model_type, binning, variant) WHERE e.mitigation <> 'baseline'),
ti AS (SELECT *, CASE WHEN gap_gain > 0 AND recall_delta >= -0.03 THEN 1 WHEN gap_gain > 0 THEN 2 ELSE 3 END AS tier FROM ga)"""
_LINEAR = "model_type = 'F'"
_ORDER = "ORDER BY gap_gain DESC NULLS LAST, recall_delta DESC NULLS LAST, f1_delta DESC NULLS LAST, experiment_id"


def _best(keys: str, where: str) -> str:
    """CTE el: eligible rows, numbered within `keys`."""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"el AS (SELECT *, row_number() OVER ({part} {_ORDER}) AS r FROM (SELECT *, min(tier) OVER ({part}) AS least FROM ti WHERE {where}) q WHERE tier = least)"


def _summary(keys: str, where: str) -> str:
    return f"""
WITH {_DELTAS}, {_GAINS}, {_best(keys, where)},
be AS (SELECT *, row_number() OVER (PARTITION BY {keys} {_ORDER}) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, mitigation {_ORDER}) AS x FROM el) q WHERE x = 1),
me AS (SELECT experiment_id, count(*) FILTER (WHERE m > 1e-12) AS improved, count(*) FILTER (WHERE m < -1e-12) AS worsened FROM (SELECT experiment_id, grp, avg(improvement) AS m FROM de GROUP BY ALL) q GROUP BY ALL)
SELECT {keys}, rank, tier, mitigation, experiment_id, gap_gain, recall_delta, f1_delta, false AS auc_unavailable, coalesce(improved, 0) AS groups_improved, coalesce(worsened, 0) AS groups_worsened
{", variant = '1' AND mitigation <> 'm3' AS mitigation_degraded" if keys == "model_type" else ""}
FROM be LEFT JOIN me USING (experiment_id) WHERE rank <= 5"""


def _gated(passes: str, floor: float, least: float) -> str:
    return f"""
WITH s AS (SELECT *, {_SCORE} AS score FROM v_exp), b AS (SELECT dataset, model_type, arg_min(score, experiment_id) AS baseline_score FROM s WHERE mitigation = 'baseline' GROUP BY ALL),
t AS (SELECT s.*, baseline_score, 100 * (baseline_score - score) / baseline_score AS dp, CASE WHEN recall < {floor} THEN 'fail' WHEN recall < {least} THEN 'lower_tier' ELSE 'full_pass' END AS recall_tier
  FROM s LEFT JOIN b USING (dataset, model_type) WHERE mitigation <> 'baseline'),
p AS (SELECT *, dp <= 15 AND recall_tier <> 'fail' AND {passes} AS ok FROM t), f AS (SELECT *, NOT (SELECT bool_or(ok) FROM p) AS is_fallback FROM p)
SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN is_fallback THEN gap END, score DESC, experiment_id) AS place, experiment_id, score, baseline_score,
  round(dp, 4) AS drop_pct, recall_tier, gap, is_fallback
FROM f WHERE ok OR is_fallback"""


def oracle_sql() -> dict[str, str]:
    return {
        "group_metric_values": "SELECT experiment_id, 'shift' AS attr, grp, metric, value, overall, metric <> 'fpr' AS higher_is_better FROM v_group_values WHERE value IS NOT NULL",
        "join_baseline_per_group": f"WITH {_PAIRED} SELECT experiment_id, attr, grp, metric, baseline_id, baseline_source, value, baseline_value, baseline_overall FROM pr",
        "group_metric_deltas": f"WITH {_DELTAS} SELECT experiment_id, attr, grp, metric, delta, improvement, distance_improvement FROM de",
        "evidence_summary": _summary("dataset", "model_type = 'F' AND dataset = 'R'"),
        "evidence_by_model": _summary("model_type", "dataset <> 'N'"),
        "degraded_warnings": "SELECT model_type, count(*) AS experiments FROM v_exp WHERE variant = '1' AND mitigation <> 'm3' GROUP BY 1",
        "gated_best": _gated("gap <= 0.42", 0.4, 0.5),
        "gated_best_fallback": _gated("gap <= 0.1", 0.9, 0.95),
        "topk_models": f"SELECT * FROM (SELECT row_number() OVER (ORDER BY score DESC, experiment_id) AS rank, experiment_id, score FROM (SELECT experiment_id, {_SCORE} AS score FROM v_exp) q) r WHERE rank <= 10",
        "best_per_strategy": f"WITH {_GAINS}, {_best('binning', _LINEAR)} SELECT binning, tier, experiment_id, mitigation, gap_gain, recall_delta, f1_delta FROM el WHERE r = 1",
        "primary_row": f"WITH {_GAINS}, {_best('', _LINEAR)} SELECT tier, experiment_id, mitigation, gap_gain, recall_delta, f1_delta FROM el WHERE r = 1",
        "baseline_best_table": """
SELECT dataset, model_type, experiment_id, f1, recall, gap
FROM (SELECT *, row_number() OVER (PARTITION BY dataset, model_type ORDER BY f1 DESC, experiment_id DESC) AS r FROM v_exp WHERE mitigation = 'baseline') q WHERE r = 1""",
        "intersectional_matrix": f"WITH {_DELTAS} SELECT mitigation, " + ", ".join(f"round(avg(improvement) FILTER (WHERE grp = '{g}'), 9) AS group_{g}" for g in GROUPS) + " FROM de GROUP BY 1",
        "selected_group_rows": f"""
WITH {_PAIRED}, be AS (SELECT experiment_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {_SCORE} DESC, gap, experiment_id) AS r FROM v_exp WHERE mitigation <> 'baseline') q WHERE r = 1)
SELECT experiment_id, grp, metric, value, baseline_value FROM pr WHERE experiment_id IN (SELECT experiment_id FROM be) AND value IS NOT NULL AND baseline_value IS NOT NULL""",
        "group_improvement_mean": f"WITH {_DELTAS} SELECT attr, grp, round(avg(improvement), 9) AS improvement, "
        + ", ".join(f"round(avg({c}) FILTER (WHERE metric = '{m}'), 9) AS {m}_{n}" for m in ("tpr", "fpr") for c, n in (("baseline_value", "before"), ("value", "after")))
        + " FROM de GROUP BY ALL",
        "experiment_list": "SELECT row_number() OVER (ORDER BY experiment_id DESC) AS place, experiment_id, dataset, model_type, mitigation FROM v_exp",
        "join_plot_frame": f"""
WITH {_GAINS}, b AS (SELECT * FROM v_exp WHERE mitigation = 'baseline')
SELECT e.experiment_id, b.experiment_id AS baseline_id, 'exact' AS baseline_source, e.f1, e.recall, e.gap, ga.recall_delta AS recall_improvement, ga.gap_gain AS gap_improvement
FROM v_exp e LEFT JOIN b USING (dataset, model_type, binning, variant) LEFT JOIN ga ON ga.experiment_id = e.experiment_id""",
        "mit_table": f"""
WITH t AS (SELECT dataset, model_type, mitigation, round(avg({_SCORE}), 9) AS mean_score, round(avg(gap), 9) AS mean_gap FROM v_exp GROUP BY ALL)
SELECT t.*, b.mean_gap AS baseline_gap, round(b.mean_gap - t.mean_gap, 6) AS gain, round(CASE WHEN b.mean_gap > 0 THEN 100 * (b.mean_gap - t.mean_gap) / b.mean_gap END, 4) AS gain_pct
FROM t LEFT JOIN (SELECT * FROM t WHERE mitigation = 'baseline') b USING (dataset, model_type)""",
        "mit_rows": "WITH b AS (SELECT * FROM v_exp WHERE mitigation = 'baseline') "
        + " UNION ALL ".join(
            f"""SELECT e.experiment_id, e.mitigation, '{m}' AS metric, b.{m} AS "before", e.{m} AS "after", round(e.{m} - b.{m}, 6) AS delta, CASE WHEN b.{m} IS NULL THEN 'no baseline' END AS note
FROM v_exp e LEFT JOIN b USING (dataset, model_type, binning, variant) WHERE e.mitigation <> 'baseline'"""
            for m in ("f1", "recall", "gap")
        ),
    }
