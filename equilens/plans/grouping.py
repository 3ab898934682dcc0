"""Queries over bins and clusters as subgroups, lineage, scored damage and rules of the triage, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.operators import binning as B
from equilens.operators import clustering as K
from equilens.operators import columns as C
from equilens.operators import lineage as L
from equilens.operators import neighbours as N
from equilens.operators import perturbation as X
from equilens.operators import profiling as D
from equilens.operators import subgroups as S
from equilens.operators import triage as T
from equilens.plans import twins as W
from equilens.sources.tables import view

Query = Callable[[SparkSession, str], DataFrame]
AGE, COARSE = [float(x) for x in W.AGE], [float(x) for x in W.COARSE]
FEATURES = ["f1", "f2"]
#: The stated query set of the sensitivity to bins and of the cumulative hits.
ASKED = "row_id % 50 = 0"
STRATEGIES = {"fine": AGE, "coarse": COARSE}
TRUTH = {"row_id": "identifier", "sex": "categorical", "gender": "categorical", "oldpeak": "numerical", "segment": "categorical"}


def _binned(df: DataFrame) -> DataFrame:
    return B.bin_apply(df, "age_raw", AGE)


def _regimes(df: DataFrame) -> DataFrame:
    """Predictions before and after a lower threshold, as two regimes."""
    both = F.array(F.struct(F.lit("before").alias("regime"), (F.col("f1") >= 250000).cast("int").alias("y_pred")), F.struct(F.lit("after").alias("regime"), (F.col("f1") >= 200000).cast("int").alias("y_pred")))
    return df.select("row_id", "segment", F.col("target").alias("y_true"), F.col("f2").alias("age_raw"), F.inline(both))


def _grid(df: DataFrame, keys: list[str]) -> DataFrame:
    rows = _regimes(df)
    near = N.consistency_by_cut(df, "row_id", FEATURES, "f1", {"before": 250000, "after": 200000}, F.expr(ASKED), 5, "regime")
    known = near.join(df.select("row_id", "segment"), "row_id")
    return S.age_sensitivity(rows, STRATEGIES, "age_raw", "row_id", keys, known.select("row_id", "consistency", *keys))


def _near(df: DataFrame, k: int) -> DataFrame:
    z = N.standardized(df, FEATURES)
    return N.knn_join(z.where(ASKED), z, "row_id", FEATURES, k, "target")


def _eps_grid(df: DataFrame) -> DataFrame:
    """Quartiles of the distance to the fifth neighbour, over all rows."""
    z = N.standardized(df, FEATURES)
    q = N.reach_quantiles(N.knn_lists(z, z, "row_id", FEATURES, 5, "target"), 5, [0.25, 0.5, 0.75])
    return q.select(*(F.round(F.col("q")[i], 6).alias(f"eps_{n}") for i, n in enumerate((25, 50, 75))))


def _clustered(df: DataFrame) -> DataFrame:
    return df.withColumn("cluster", F.col("row_id") % 4).withColumn("f3", F.col("f1") * (1 + F.col("cluster")))


def _measures(df: DataFrame) -> DataFrame:
    """Measures of a dataset as (dataset, metric, value), from experiments."""
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(c).alias("value")) for m, c in (("F2", "gap"), ("N3", "recall"), ("L1", "f1"), ("T1", "auc"))))
    return df.select("dataset", F.inline(each)).groupBy("dataset", "metric").agg(F.max("value").alias("value"))


def _whole(df: DataFrame) -> DataFrame:
    return _measures(df).groupBy("metric").agg(F.max("value").alias("value"))


def _overlap(df: DataFrame) -> DataFrame:
    groups = _measures(df).select(F.lit("dataset").alias("attr"), F.col("dataset").alias("grp"), "metric", "value")
    reference = C.reference_quantiles(df.select(F.lit("F2").alias("metric"), F.col("gap").alias("value")), {"N3": (0.0, 0.15, 0.25, 0.35, 1.0)})
    return T.rule_overlap(_whole(df), groups, reference)


def _framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view(spark, sf_dir, "v_doc").where("quality IS NOT NULL").withColumn("class", F.col("quality") + F.col("toxic"))
    return T.rule_task_framing(docs, ["lang", "source"], "class", _whole(view(spark, sf_dir, "v_exp")))


def _site(spark: SparkSession, sf_dir: str, rest: int) -> DataFrame:
    return view(spark, sf_dir, "v_clinic").where(F.col("row_id") % 3 == rest).select("row_id", "site", "segment", "chol", "cp")


def _cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cohort_build({"a": _site(spark, sf_dir, 0), "b": _site(spark, sf_dir, 1)}, ["site", "segment", "cp"], ["row_id"])


def _damaged(df: DataFrame, p: float) -> DataFrame:
    damaged = df
    for c in ("gender", "segment"):
        damaged = X.inject_missing_mcar(damaged, "row_id", c, p)
    copies = X.inject_duplicates(damaged, "row_id", p).drop("copy_no")
    return X.join_truth(C.triage_column_type(D.column_profile(copies)), TRUTH, "type")


def _raw_meta(df: DataFrame) -> DataFrame:
    return L.join_raw_meta(N.standardized(df.drop("y_pred"), FEATURES, 4), df, "row_id", ["f2"], "target").select("row_id", "target", "f2", "f2_raw")


def queries() -> dict[str, Query]:
    def on(name: str, op: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: op(view(spark, sf_dir, name))

    age, knn, exp, clinic = (lambda op, n=n: on(n, op) for n in ("v_age", "v_knn", "v_exp", "v_clinic"))
    with_group = lambda d: _binned(d.withColumn("grp", (F.col("row_id") % 3).cast("string")))
    profile = lambda d: K.profile(_clustered(d), ["f1", "f2", "f3", "y_pred"], "target")
    split = lambda d: (d.where("row_id % 5 <> 0"), d.where("row_id % 5 = 0"))
    return {
        "bin_equal_width": age(lambda d: B.bin_stats(B.bin_apply(d, "age_raw", B.equal_width_edges(d, "age_raw", 5)), "age_raw", "target")),
        "bin_identity": clinic(lambda d: B.bin_apply(d, "cp", B.identity_edges(d, "cp", 10)).select("row_id", "bin")),
        "bin_adaptive_quantile": age(lambda d: B.bin_stats(B.bin_apply(d, "age_raw", S.adaptive_quantile_edges(d, "age_raw", 4, 30)), "age_raw", "target")),
        "bin_cross_impact": age(lambda d: S.cross_impact(with_group(d), ["sex", "grp"], "target")),
        "bin_analysis": age(lambda d: S.bin_analysis(with_group(d), "age_raw", "target", ["sex", "grp"])),
        "bin_recommend": age(lambda d: S.bin_recommend(_binned(d).withColumn("target", F.when(F.col("bin") == 0, 1 - (F.col("row_id") % 20 == 0).cast("int") ).otherwise(F.col("target"))), "target")),
        "num_bin_label": age(lambda d: S.labelled_bins(d, "age_raw", AGE, False)),
        "num_bin_label_whole": clinic(lambda d: S.labelled_bins(d, "site", [0.0, 5.0, 5.5, 6.0, 24.0], True)),
        "age_sensitivity_grid": knn(lambda d: _grid(d, ["regime"])),
        "age_sensitivity_summary": knn(lambda d: S.age_sensitivity_summary(_grid(d, ["regime"]), ["regime"])),
        "age_sensitivity_run": knn(lambda d: S.age_sensitivity_deltas(_grid(d, ["regime", "segment"]), ["segment"])),
        "cumulative_hits": knn(lambda d: S.cumulative_hits(_near(d, 10), "row_id")),
        "topk_cluster_features": knn(lambda d: S.top_cluster_features(profile(d), 2)),
        "topk_dominant_features": knn(lambda d: S.top_cluster_features(profile(d), 3, True)),
        "topk_features_importance": knn(lambda d: S.top_features(D.correlation(d, ["target", "f1", "f2", "y_pred"]).where("a = 'target'").select(F.col("b").alias("feature"), F.col("r").alias("importance")), 2)),
        "rank_average": on("v_doc", lambda d: S.rank_average(d, "doc_id", "quality")),
        "nearest_centroid_join": knn(lambda d: S.nearest_centroid_join(d.select("row_id", *FEATURES), S.centroids_of(_clustered(d), "cluster", FEATURES), FEATURES).select("row_id", "cluster")),
        "cluster_assign_test": knn(lambda d: S.cluster_assign_test(*split(_clustered(d)), "cluster", FEATURES).select("row_id", "cluster")),
        "cluster_list": knn(lambda d: S.cluster_list(_clustered(d), ["f1", "f2", "f3"], "target")),
        "cluster_eps_grid": knn(_eps_grid),
        "complexity_f_by_group": age(lambda d: S.complexity_f_by(d.withColumn("sex", F.when(F.col("age_raw") < -980, "DEBT").otherwise(F.col("sex"))), ["sex"], "age_raw", "target")),
        "complexity_f_intersection": age(lambda d: S.complexity_f_by(d.withColumn("cell", F.concat_ws("|", "sex", (F.col("row_id") % 3).cast("string"))), ["cell"], "age_raw", "target")),
        "subgroup_generators": age(lambda d: S.with_generators(d, [lambda t: t.withColumn("third", F.col("row_id") % 3), lambda t: t.withColumn("cell", F.concat_ws("|", "sex", F.col("third").cast("string")))]).groupBy("cell").agg(F.count("*").alias("n"))),
        "rule_task_framing": _framing,
        "rule_overlap": exp(_overlap),
        "rule_explainability": exp(lambda d: T.rule_explainability(_whole(d))),
        "union_splits": lambda s, d: L.union_splits({"train": _site(s, d, 0), "test": _site(s, d, 1).drop("chol")}),
        "join_labels": lambda s, d: L.join_on_rows(view(s, d, "v_cases").select("case_id", "race"), view(s, d, "v_case_labels"), "case_id", ["weights"], "inner"),
        "join_cluster_labels": knn(lambda d: L.join_on_rows(d.select("row_id", "y_pred"), _clustered(d).where("row_id % 7 > 0"), "row_id", ["cluster"])),
        "join_raw_meta": knn(_raw_meta),
        "join_cv_features": knn(lambda d: L.join_on_rows(d.select("row_id", "target"), d, "row_id", FEATURES)),
        "join_patient_split": on("v_group", lambda d: L.join_patient_split(d, d.where("patient % 4 = 0"), "patient").select("row_id")),
        "cohort_build": _cohort,
        "provenance_report": clinic(lambda d: L.provenance_report(d, d.where("thal IS NOT NULL AND chol IS NOT NULL").withColumn("y", F.col("cp") % 2), "row_id", ["thal", "chol"], {"cp": (1, 4), "chol": (10, 240)}, "y")),
        "mapping_verification": clinic(lambda d: L.mapping_verification(d.withColumn("code", F.when(F.col("cp") == 4, 0).otherwise(F.col("cp"))), {"cp": ("cp", "code"), "chol": ("chol", "cholesterol")})),
        "join_truth_vs_profile": clinic(lambda d: _damaged(d, 0.3)),
        "score_profiler": clinic(lambda d: X.score_profiler({p: _damaged(d, p) for p in (0.0, 0.3)})),
        "type_confusion": clinic(lambda d: X.type_confusion(_damaged(d, 0.3))),
        "sweep_grid": exp(lambda d: S.sweep_grid(d, {"dataset": ["A", "N", "R"], "mitigation": ["baseline", "m1", "m2", "m3"], "method": ["holdout", "cv"], "model": ["F", "O"]}, [("model", "O", "mitigation", "m3"), ("method", "cv", "mitigation", "m2")])),
    }


_Z = "z AS (SELECT row_id, segment, target, f1 AS raw, round((f1 - avg(f1) OVER ()) / stddev_pop(f1) OVER (), 6) AS f1, round((f2 - avg(f2) OVER ()) / stddev_pop(f2) OVER (), 6) AS f2 FROM v_knn)"
_D = "round(sqrt((q.f1 - r.f1) * (q.f1 - r.f1) + (q.f2 - r.f2) * (q.f2 - r.f2)), 9)"


def _near_sql(asked: str = "") -> str:
    """CTE near: the 10 nearest of all rows, or of those that `asked` says."""
    return f"""
{_Z},
near AS (SELECT * FROM (
  SELECT q.row_id, q.segment, q.target, r.target AS other, q.raw, r.raw AS other_raw, {_D} AS dist, row_number() OVER (PARTITION BY q.row_id ORDER BY {_D}, r.row_id) AS k FROM z q JOIN z r ON {asked and f'q.{asked} AND '}q.row_id <> r.row_id) t
  WHERE k <= 10)"""


def _grid_sql(keys: str) -> str:
    regimes = (("before", 250000), ("after", 200000))
    cons = " UNION ALL ".join(f"SELECT row_id, segment, '{r}' AS regime, count(*) FILTER (WHERE (raw >= {x}) = (other_raw >= {x})) / 5.0 AS c FROM near WHERE k <= 5 GROUP BY 1, 2" for r, x in regimes)
    rows = " UNION ALL ".join(
        f"SELECT row_id, segment, target AS t, '{r}' AS regime, CASE WHEN f1 >= {x} THEN 1 ELSE 0 END AS p, '{s}' AS strategy, {W.bins(e, 'f2')} AS bin FROM v_knn" for r, x in regimes for s, e in (("fine", W.AGE), ("coarse", W.COARSE))
    )
    over = f"OVER (PARTITION BY {keys}, strategy)"
    gap = lambda m: f"round(max({m}) {over} - min({m}) {over}, 6)"
    return f"""
{_near_sql(ASKED)}, co AS ({cons}), ro AS ({rows}),
ra AS (SELECT {keys}, strategy, bin, count(*) AS n, avg(p) AS pr, coalesce(avg(p) FILTER (WHERE t = 1), 0) AS tpr, coalesce(avg(p) FILTER (WHERE t = 0), 0) AS fpr FROM ro WHERE bin IS NOT NULL GROUP BY ALL),
me AS (SELECT {', '.join('ro.' + x.strip() for x in keys.split(','))}, strategy, bin, round(avg(c), 6) AS mean_consistency FROM ro JOIN co USING (row_id, regime) WHERE bin IS NOT NULL GROUP BY ALL),
gr AS (SELECT {keys}, strategy, bin, n, round(pr, 6) AS positive_rate, {gap('pr')} AS dp_gap, {gap('tpr')} AS eo_tpr_gap, {gap('fpr')} AS eo_fpr_gap, mean_consistency, n < 20 AS low_n FROM ra LEFT JOIN me USING ({keys}, strategy, bin))"""


_BIN = W.bins(W.AGE)
_IMPACT = f"""
l AS (SELECT bin, target, 'sex' AS attr, sex AS grp FROM (SELECT *, {_BIN} AS bin FROM v_age) q UNION ALL SELECT bin, target, 'grp', CAST(row_id % 3 AS VARCHAR) FROM (SELECT *, {_BIN} AS bin FROM v_age) q),
i AS (SELECT attr, max(w) AS within, (SELECT max(r) - min(r) FROM (SELECT avg(target) AS r FROM l x WHERE x.attr = y.attr AND bin IS NOT NULL GROUP BY grp) o) AS overall
  FROM (SELECT attr, bin, max(r) - min(r) AS w FROM (SELECT attr, bin, grp, avg(target) AS r FROM l WHERE bin IS NOT NULL GROUP BY ALL) a GROUP BY ALL) y GROUP BY attr)"""
_BR = f"b AS (SELECT {_BIN} AS bin, count(*) AS n, CAST(sum(target) AS DOUBLE) / count(*) AS rate, sum(target) AS pos FROM v_age GROUP BY 1 HAVING bin IS NOT NULL)"
_CL = "d AS (SELECT *, row_id % 4 AS cluster, f1 * (1 + row_id % 4) AS f3 FROM v_knn)"


def _top(features: tuple[str, ...], k: int, deviation: bool) -> str:
    """CTE p: the k features of a cluster that are farthest from the whole."""
    per = " UNION ALL ".join(f"SELECT cluster, '{f}' AS feature, round(avg({f}), 6) AS mean, round(stddev_samp({f}), 6) AS s, (SELECT round(avg({f}), 6) FROM d) AS o FROM d GROUP BY 1" for f in features)
    far = "CASE WHEN s > 0 THEN abs(mean - o) / s END" if deviation else "abs(mean - o)"
    return f"p AS (SELECT cluster, feature, difference, CAST(row_number() OVER (PARTITION BY cluster ORDER BY difference DESC NULLS LAST, feature) AS INTEGER) AS rank FROM (SELECT cluster, feature, round({far}, 4) AS difference FROM ({per}) a) q QUALIFY rank <= {k})"


_MEASURES = "m AS (SELECT dataset, metric, max(value) AS value FROM (" + " UNION ALL ".join(f"SELECT dataset, '{m}' AS metric, {c} AS value FROM v_exp" for m, c in (("F2", "gap"), ("N3", "recall"), ("L1", "f1"), ("T1", "auc"))) + ") q GROUP BY ALL), w AS (SELECT metric, max(value) AS value FROM m GROUP BY 1)"


def _complexity(cell: str, name: str) -> str:
    return f"""
WITH a AS (SELECT *, {cell} AS c FROM v_age),
r AS (SELECT c, min(age_raw) FILTER (WHERE target = 0) AS l0, max(age_raw) FILTER (WHERE target = 0) AS h0, min(age_raw) FILTER (WHERE target = 1) AS l1, max(age_raw) FILTER (WHERE target = 1) AS h1, count(*) AS n FROM a GROUP BY 1),
s AS (SELECT c, count(*) FILTER (WHERE age_raw BETWEEN greatest(l0, l1) AND least(h0, h1)) / CAST(count(*) AS DOUBLE) AS s FROM a JOIN r USING (c) GROUP BY 1)
SELECT c AS {name}, n, CASE WHEN n >= 50 THEN round(greatest(0, least(h0, h1) - greatest(l0, l1)) / (greatest(h0, h1) - least(l0, l1)), 6) END AS f2, CASE WHEN n >= 50 THEN round(s, 6) END AS f3, CASE WHEN n >= 50 THEN round(s, 6) END AS f4,
  CASE WHEN n >= 50 THEN 'ok' ELSE 'skipped' END AS status
FROM r JOIN s USING (c)"""


def _damage(p: float) -> str:
    """Expected and observed types of the columns of TRUTH after the damage of `_damaged`."""
    share = lambda salt: f"CAST('0x' || substr(md5('{salt}:' || CAST(row_id AS VARCHAR)), 1, 7) AS BIGINT) / 268435456.0"
    known = lambda c: f"CASE WHEN {share(c)} >= {p} THEN {c} END" if c in ("gender", "segment") else c
    rows = f"(SELECT count(*) + count(*) FILTER (WHERE {share('copy')} < {p}) AS n FROM v_clinic) n"
    one = lambda c, t: f"SELECT '{c}' AS \"column\", '{t}' AS expected, {c in ('row_id', 'sex', 'oldpeak')} AS numeric, u, n FROM (SELECT count(DISTINCT {known(c)}) AS u FROM v_clinic) u, {rows}"
    kind = "CASE WHEN u >= 0.99 * n AND n > 10 THEN 'identifier' WHEN u = 2 THEN 'binary' WHEN u <= 20 THEN 'categorical' WHEN numeric THEN 'numerical' ELSE 'text' END"
    return f"SELECT \"column\", expected, {kind} AS observed FROM ({' UNION ALL '.join(one(c, t) for c, t in TRUTH.items())}) q"


def oracle_sql() -> dict[str, str]:
    width = "(SELECT min(age_raw) AS lo, max(age_raw) AS hi FROM v_age)"
    steps = " ".join(f"WHEN age_raw <= lo + (hi - lo) / 5.0 * {i} THEN {i - 1}" for i in range(1, 5))
    stats = "count(*) AS n, round(avg(target), 6) AS rate, min(age_raw) AS low, max(age_raw) AS high, round(count(*) / CAST((SELECT count(*) FROM v_age) AS DOUBLE), 6) AS share"
    changed = f"SELECT {_BIN} AS bin, CASE WHEN {_BIN} = 0 THEN CASE WHEN row_id % 20 = 0 THEN 0 ELSE 1 END ELSE target END AS target FROM v_age"
    labels = " ".join(f"WHEN {i} THEN '({a}.00, {b}.00]'" for i, (a, b) in enumerate(zip(W.AGE, W.AGE[1:])))
    site = "SELECT row_id, site, segment, chol, cp FROM v_clinic WHERE row_id % 3 ="
    return {
        "bin_equal_width": f"SELECT CAST(CASE {steps} ELSE 4 END AS INTEGER) AS bin, {stats} FROM v_age, {width} e GROUP BY 1",
        "bin_identity": "SELECT row_id, CAST(dense_rank() OVER (ORDER BY cp) - 1 AS INTEGER) AS bin FROM v_clinic",
        "bin_adaptive_quantile": f"""
WITH q AS (SELECT min(age_raw) AS q0, quantile_cont(age_raw, 0.25) AS q1, quantile_cont(age_raw, 0.5) AS q2, quantile_cont(age_raw, 0.75) AS q3, max(age_raw) AS q4 FROM v_age)
SELECT {W.bins(('q0', 'q1', 'q2', 'q3', 'q4'))} AS bin, {stats} FROM v_age, q GROUP BY 1""",
        "bin_cross_impact": f"WITH {_IMPACT} SELECT attr, round_even(overall, 4) AS global_sp, round_even(within, 4) AS max_within_bin_sp, round_even(within - overall, 4) AS delta FROM i",
        "bin_analysis": f"""
WITH {_IMPACT}, {_BR}, f AS (SELECT round(stddev_samp(n) / avg(n), 6) AS cv, round(max(rate) - min(rate), 6) AS gap, round(min(rate) / max(rate), 6) AS dp_ratio,
  round(max(abs(rate - (SELECT CAST(sum(pos) AS DOUBLE) / sum(n) FROM b))), 6) AS max_deviation FROM b)
SELECT 'size' AS section, CAST(bin AS VARCHAR) AS item, CAST(n AS DOUBLE) AS value FROM b UNION ALL SELECT 'rate', CAST(bin AS VARCHAR), round(rate, 6) FROM b
UNION ALL SELECT 'fairness', name, value FROM f UNPIVOT (value FOR name IN (cv, gap, dp_ratio, max_deviation)) UNION ALL SELECT 'impact', attr, round_even(within - overall, 4) FROM i""",
        "bin_recommend": f"""
WITH t AS (SELECT bin, avg(target) AS rate FROM ({changed}) q WHERE bin IS NOT NULL GROUP BY 1), d AS (SELECT arg_max(bin, (rate, bin)) AS highest, arg_min(bin, (rate, bin)) AS lowest, max(rate) / min(rate) AS ratio FROM t)
SELECT CASE WHEN ratio >= 3 THEN 'P0' ELSE 'P1' END AS priority, highest, lowest, round(ratio, 6) AS ratio FROM d WHERE ratio >= 1.5""",
        "num_bin_label": f"SELECT bin, CASE bin {labels} END AS label FROM (SELECT DISTINCT {_BIN} AS bin FROM v_age) q WHERE bin IS NOT NULL",
        "num_bin_label_whole": """
SELECT bin, CASE WHEN min(site) = max(site) THEN CAST(min(site) AS VARCHAR) ELSE CAST(min(site) AS VARCHAR) || '-' || CAST(max(site) AS VARCHAR) END AS label
FROM (SELECT site, CASE WHEN site <= 5 THEN 0 WHEN site <= 5.5 THEN 1 WHEN site <= 6 THEN 2 ELSE 3 END AS bin FROM v_clinic) q GROUP BY 1""",
        "age_sensitivity_grid": f"WITH {_grid_sql('regime')} SELECT * FROM gr",
        "age_sensitivity_summary": f"WITH {_grid_sql('regime')} SELECT regime, strategy, count(*) AS bins, count(*) FILTER (WHERE low_n) AS low_n, max(dp_gap) AS dp_gap FROM gr GROUP BY ALL",
        "age_sensitivity_run": f"""
WITH {_grid_sql('regime, segment')}, p AS (SELECT segment, strategy, bin, max(dp_gap) FILTER (WHERE regime = 'before') AS "before", max(dp_gap) FILTER (WHERE regime = 'after') AS "after" FROM gr GROUP BY ALL)
SELECT *, round("after" - "before", 6) AS delta FROM p""",
        "cumulative_hits": f"WITH {_near_sql(ASKED)} SELECT row_id, CAST(k AS INTEGER) AS rank, CAST(sum(CASE WHEN target = other THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY k) AS BIGINT) AS hits FROM near",
        "topk_cluster_features": f"WITH {_CL}, {_top(('f1', 'f2', 'f3', 'y_pred'), 2, False)} SELECT cluster, rank, feature, difference FROM p",
        "topk_dominant_features": f"WITH {_CL}, {_top(('f1', 'f2', 'f3', 'y_pred'), 3, True)} SELECT cluster, rank, feature, difference FROM p",
        "topk_features_importance": """
WITH c AS (SELECT 'f1' AS feature, round(corr(target, f1), 6) AS importance FROM v_knn UNION ALL SELECT 'f2', round(corr(target, f2), 6) FROM v_knn UNION ALL SELECT 'y_pred', round(corr(target, y_pred), 6) FROM v_knn)
SELECT CAST(row_number() OVER (ORDER BY abs(importance) DESC, feature) AS INTEGER) AS rank, feature, importance FROM c QUALIFY rank <= 2""",
        "rank_average": """
WITH r AS (SELECT doc_id, quality, rank() OVER (ORDER BY quality NULLS LAST) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0::DOUBLE AS rank, count(*) OVER () AS n FROM v_doc)
SELECT doc_id, rank, round(rank / n, 9) AS share FROM r""",
        "nearest_centroid_join": f"""
WITH {_CL}, c AS (SELECT cluster, avg(f1) AS a, avg(f2) AS b FROM d GROUP BY 1)
SELECT row_id, cluster FROM (SELECT row_id, c.cluster, row_number() OVER (PARTITION BY row_id ORDER BY round(sqrt((f1 - a) * (f1 - a) + (f2 - b) * (f2 - b)), 9), c.cluster) AS k FROM d, c) q WHERE k = 1""",
        "cluster_assign_test": f"""
WITH {_CL}, t AS (SELECT avg(f1) AS m1, stddev_pop(f1) AS s1, avg(f2) AS m2, stddev_pop(f2) AS s2 FROM d WHERE row_id % 5 <> 0), x AS (SELECT row_id, cluster, (f1 - m1) / s1 AS a, (f2 - m2) / s2 AS b FROM d, t),
c AS (SELECT cluster AS g, avg(a) AS ca, avg(b) AS cb FROM x WHERE row_id % 5 <> 0 GROUP BY 1)
SELECT row_id, g AS cluster FROM (SELECT row_id, g, row_number() OVER (PARTITION BY row_id ORDER BY round(sqrt((a - ca) * (a - ca) + (b - cb) * (b - cb)), 9), g) AS k FROM x, c WHERE row_id % 5 = 0) q WHERE k = 1""",
        "cluster_list": f"""
WITH {_CL}, {_top(('f1', 'f2', 'f3'), 1, True)}
SELECT cluster, n, rate, round(100 * n / CAST((SELECT count(*) FROM d) AS DOUBLE), 4) AS pct, feature AS dominant FROM (SELECT cluster, count(*) AS n, round(avg(target), 6) AS rate FROM d GROUP BY 1) s JOIN p USING (cluster)""",
        "cluster_eps_grid": f"WITH {_near_sql()} SELECT " + ", ".join(f"round(quantile_cont(dist, {q / 100}), 6) AS eps_{q}" for q in (25, 50, 75)) + " FROM near WHERE k = 5",
        "complexity_f_by_group": _complexity("CASE WHEN age_raw < -980 THEN 'DEBT' ELSE sex END", "sex"),
        "complexity_f_intersection": _complexity("sex || '|' || CAST(row_id % 3 AS VARCHAR)", "cell"),
        "subgroup_generators": "SELECT sex || '|' || CAST(row_id % 3 AS VARCHAR) AS cell, count(*) AS n FROM v_age GROUP BY 1",
        "rule_task_framing": f"""
WITH {_MEASURES}, d AS (SELECT *, quality + toxic AS class FROM v_doc WHERE quality IS NOT NULL), l AS (SELECT 'lang' AS attr, lang AS grp, class FROM d WHERE lang IS NOT NULL AND class IS NOT NULL UNION ALL SELECT 'source', source, class FROM d WHERE source IS NOT NULL AND class IS NOT NULL),
f AS (SELECT count(*) FILTER (WHERE n < 20) AS few FROM (SELECT count(*) AS n FROM l GROUP BY attr, grp, class) q), h AS (SELECT count(*) FILTER (WHERE value > 0.5) AS high FROM w), k AS (SELECT * FROM f, h WHERE (SELECT count(DISTINCT class) FROM d) > 2)
SELECT 'framing' AS category, 'P1' AS priority, 'low_support' AS rule, 'class' AS subject, CAST(few AS DOUBLE) AS evidence FROM k WHERE few > 0
UNION ALL SELECT 'framing', 'P2', 'high_complexity', 'class', high FROM k WHERE few = 0 AND high > 0""",
        "rule_overlap": f"""
WITH {_MEASURES}, r AS (SELECT 'F2' AS metric, round(quantile_cont(gap, 0.75), 6) AS p75 FROM v_exp UNION ALL SELECT 'N3', 0.35)
SELECT 'overlap' AS category, 'P1' AS priority, 'elevated' AS rule, metric AS subject, round(value, 4) AS evidence FROM w LEFT JOIN r USING (metric) WHERE metric <> 'L1' AND value > coalesce(p75, 0.5)
UNION ALL SELECT 'overlap', 'P2', 'group_differs', 'dataset=' || dataset, round(abs(m.value - w.value) / abs(w.value), 4) FROM m JOIN w USING (metric) WHERE w.value <> 0 AND round(abs(m.value - w.value) / abs(w.value), 9) > 0.2""",
        "rule_explainability": f"WITH {_MEASURES} SELECT 'explainability' AS category, 'P2' AS priority, 'hard_to_explain' AS rule, metric AS subject, round(value, 4) AS evidence FROM w WHERE metric IN ('L1', 'T1') AND value > 0.5",
        "union_splits": f"SELECT *, 'train' AS split FROM ({site} 0) a UNION ALL SELECT row_id, site, segment, NULL, cp, 'test' FROM ({site} 1) b",
        "join_labels": "SELECT case_id, race, weights FROM v_cases JOIN v_case_labels USING (case_id)",
        "join_cluster_labels": "SELECT row_id, y_pred, CASE WHEN row_id % 7 > 0 THEN row_id % 4 END AS cluster FROM v_knn",
        "join_raw_meta": "SELECT row_id, target, round((f2 - avg(f2) OVER ()) / stddev_pop(f2) OVER (), 4) AS f2, f2 AS f2_raw FROM v_knn",
        "join_cv_features": "SELECT row_id, target, f1, f2 FROM v_knn",
        "join_patient_split": "SELECT row_id FROM v_group WHERE patient % 4 = 0",
        "cohort_build": f"""
SELECT row_id, site, segment, chol, cp, source_site
FROM (SELECT *, row_number() OVER (PARTITION BY site, segment, cp ORDER BY source_site, row_id) AS k FROM (SELECT *, 'a' AS source_site FROM ({site} 0) a UNION ALL SELECT *, 'b' FROM ({site} 1) b) u) q WHERE k = 1""",
        "provenance_report": """
WITH c AS (SELECT * FROM v_clinic WHERE thal IS NOT NULL AND chol IS NOT NULL)
SELECT 'dropped_are_incomplete' AS "check", 0.0::DOUBLE AS value, true AS holds FROM (SELECT count(*) FROM c) o UNION ALL SELECT 'range_cp', count(*) FILTER (WHERE cp NOT BETWEEN 1 AND 4), count(*) FILTER (WHERE cp NOT BETWEEN 1 AND 4) = 0 FROM c
UNION ALL SELECT 'range_chol', count(*) FILTER (WHERE chol NOT BETWEEN 10 AND 240), count(*) FILTER (WHERE chol NOT BETWEEN 10 AND 240) = 0 FROM c
UNION ALL SELECT 'positive_share', round(avg(cp % 2), 6), avg(cp % 2) BETWEEN 0.2 AND 0.8 FROM c""",
        "mapping_verification": """
SELECT 'cp' AS rule, count(*) FILTER (WHERE cp = 4) AS mismatches FROM v_clinic UNION ALL SELECT 'chol', count(*) FILTER (WHERE chol IS DISTINCT FROM cholesterol) FROM v_clinic""",
        "join_truth_vs_profile": f"SELECT *, expected = observed AS hit FROM ({_damage(0.3)}) t",
        "score_profiler": f"""
SELECT k AS knob, count(*) AS columns, round(avg(CASE WHEN expected = observed THEN 1 ELSE 0 END), 6) AS accuracy
FROM (SELECT 0.0::DOUBLE AS k, * FROM ({_damage(0.0)}) a UNION ALL SELECT 0.3, * FROM ({_damage(0.3)}) b) t GROUP BY 1""",
        "type_confusion": f"SELECT expected, observed, count(*) AS n FROM ({_damage(0.3)}) t GROUP BY ALL",
        "sweep_grid": """
SELECT dataset, mitigation, method, model, e.experiments
FROM (VALUES ('A'), ('N'), ('R')) a(dataset), (VALUES ('baseline'), ('m1'), ('m2'), ('m3')) b(mitigation), (VALUES ('holdout'), ('cv')) c(method), (VALUES ('F'), ('O')) d(model)
  LEFT JOIN (SELECT dataset AS ds, mitigation AS mi, model_type AS mo, count(*) AS experiments FROM v_exp GROUP BY ALL) e ON ds = dataset AND mi = mitigation AND mo = model
WHERE NOT (model = 'O' AND mitigation = 'm3') AND NOT (method = 'cv' AND mitigation = 'm2')""",
    }
