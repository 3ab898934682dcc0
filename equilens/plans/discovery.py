"""Queries over neighbours, clusters, triage rules, table damage and further experiment tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.operators import clustering as C
from equilens.operators import experiments as E
from equilens.operators import neighbours as N
from equilens.operators import perturbation as X
from equilens.operators import triage as T
from equilens.sources.tables import stored, view

Query = Callable[[SparkSession, str], DataFrame]
FEATURES = ["f1", "f2"]
K = 5
#: The stated query set of the measures by group and at several depths.
ASKED = "row_id % 50 = 0"


def _neighbours(label: str, k: int = K, asked: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """The neighbours of all rows, or of those that `asked` says."""

    def near(df: DataFrame) -> DataFrame:
        z = N.standardized(df, FEATURES)
        return N.knn_join(z.where(asked) if asked else z, z, "row_id", FEATURES, k, label)

    return near


def _lists(df: DataFrame, label: str) -> DataFrame:
    """The neighbours of all rows, a list for each."""
    z = N.standardized(df, FEATURES)
    return N.knn_lists(z, z, "row_id", FEATURES, K, label)


def _by_group(df: DataFrame) -> DataFrame:
    per = N.consistency(_neighbours("y_pred", asked=ASKED)(df), "row_id", K)
    return N.consistency_summary(per.join(df.where(ASKED).select("row_id", "segment"), "row_id"), ["segment"])


def _n2(df: DataFrame) -> DataFrame:
    z = N.standardized(df, FEATURES)
    return N.n2(z, z, "row_id", FEATURES, "target")


def _clusters(df: DataFrame) -> DataFrame:
    return C.select(N.standardized(df, FEATURES), FEATURES, "kmeans")


def _rules(df: DataFrame) -> DataFrame:
    return T.rules_all(df, ["lang", "source"], "quality", "doc_id")


def queries() -> dict[str, Query]:
    def on(name: str, op: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: op(view(spark, sf_dir, name))

    doc, exp = (lambda op, n=n: on(n, op) for n in ("v_doc", "v_exp"))

    def knn(op: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: op(stored(spark, sf_dir, "v_knn"))

    return {
        "knn_consistency": knn(lambda d: N.consistency_summary(N.list_consistency(_lists(d, "y_pred"), "row_id", K))),
        "knn_consistency_by_group": knn(_by_group),
        "knn_consistency_multi_k": knn(lambda d: N.consistency_multi_k(_neighbours("y_pred", 20, ASKED)(d), "row_id", [5, 10, 20])),
        "cx_n2": knn(_n2),
        "cx_n3": knn(lambda d: N.n3(_neighbours("target", 1)(d))),
        "cx_raug": knn(lambda d: N.raug(_lists(d, "target"))),
        "cluster_diagnostics": knn(lambda d: C.diagnostics(N.standardized(d, FEATURES), FEATURES)),
        "cluster_profile": knn(lambda d: C.profile(_clusters(d), FEATURES, "target")),
        "cluster_balance_gate": knn(lambda d: C.balance_gate(_clusters(d))),
        "cluster_recommend": knn(lambda d: C.recommend(_clusters(d), "target")),
        "rule_representation": doc(lambda d: T.rule_representation(T.attribute_profile(d, ["lang", "source"], "quality"))),
        "rule_sensitive_adequacy": doc(lambda d: T.rule_sensitive_adequacy(T.attribute_profile(d, ["lang", "source", "toxic"], "quality"))),
        "rule_data_quality": doc(lambda d: T.rule_data_quality(d, "quality", "doc_id")),
        "rules_all": doc(_rules),
        "triage_counts": doc(lambda d: T.triage_counts(_rules(d))),
        "rule_readiness": doc(lambda d: T.readiness(_rules(d))),
        "low_support_intersections": doc(lambda d: T.low_support_intersections(d, "lang", "source")),
        "inject_missing_mcar": doc(lambda d: X.inject_missing_mcar(d.select("doc_id", "n_chars"), "doc_id", "n_chars", 0.2)),
        "inject_missing_mar": doc(lambda d: X.inject_missing_mar(d.select("doc_id", "lang", "n_chars"), "doc_id", "n_chars", "lang", {"en": 2.0}, 0.2)),
        "inject_duplicates": doc(lambda d: X.inject_duplicates(d.select("doc_id", "lang"), "doc_id", 0.1)),
        "mode_scores": exp(E.mode_scores),
        "stage_gap_deltas": exp(E.stage_gap_deltas),
        "before_after_best": exp(E.before_after_best),
        "experiment_summary": exp(E.experiment_summary),
        "mitigation_gap_matrix": exp(E.mitigation_gap_matrix),
    }


_Z = "z AS (SELECT row_id, target, y_pred, segment, round((f1 - avg(f1) OVER ()) / stddev_pop(f1) OVER (), 6) AS f1, round((f2 - avg(f2) OVER ()) / stddev_pop(f2) OVER (), 6) AS f2 FROM v_knn)"
_D = "round(sqrt((q.f1 - r.f1) * (q.f1 - r.f1) + (q.f2 - r.f2) * (q.f2 - r.f2)), 9)"


def _near(asked: str = "") -> str:
    """CTE near: the 20 nearest of all rows, or of those that `asked` says."""
    return f"{_Z}, near AS (SELECT * FROM (SELECT q.row_id, q.segment, q.y_pred, q.target, r.y_pred AS o_pred, r.target AS o_target, {_D} AS dist, row_number() OVER (PARTITION BY q.row_id ORDER BY {_D}, r.row_id) AS k FROM z q JOIN z r ON {asked and f'q.{asked} AND '}q.row_id <> r.row_id) t WHERE k <= 20)"


_SUMMARY = "round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std, min(c) AS min, median(c) AS median, count(*) AS n"


def _consistent(k: int) -> str:
    return f"SELECT row_id, segment, count(*) FILTER (WHERE y_pred = o_pred) / {k}.0 AS c FROM near WHERE k <= {k} GROUP BY 1, 2"


_ATTRS = "g AS ({}), a AS (SELECT attr, count(grp) AS groups, min(n) FILTER (WHERE grp IS NOT NULL) AS least, max(n) FILTER (WHERE grp IS NOT NULL) AS most, max(rate) FILTER (WHERE grp IS NOT NULL) - min(rate) FILTER (WHERE grp IS NOT NULL) AS gap, coalesce(sum(n) FILTER (WHERE grp IS NULL), 0) / CAST(sum(n) AS DOUBLE) AS nulls FROM g GROUP BY 1), p AS (SELECT *, most / CAST(least AS DOUBLE) AS ratio FROM a)"


def _attrs(names: tuple[str, ...]) -> str:
    return _ATTRS.format(" UNION ALL ".join(f"SELECT '{a}' AS attr, CAST({a} AS VARCHAR) AS grp, count(*) AS n, avg(quality) AS rate FROM v_doc GROUP BY 2" for a in names))


def _said(category: str, priority: str, rule: str, subject: str, evidence: str, source: str, when: str) -> str:
    return f"SELECT '{category}' AS category, '{priority}' AS priority, '{rule}' AS rule, {subject} AS subject, round(CAST({evidence} AS DOUBLE), 4) AS evidence FROM {source} WHERE {when}"


_REPRESENTATION = " UNION ALL ".join(_said("representation", p, r, "attr", e, "p", w) for p, r, e, w in (("P1", "size_ratio", "ratio", "ratio > 3"), ("P1", "parity", "gap", "round(gap, 9) > 0.15"), ("P1", "small_group", "least", "least < 50"), ("P2", "rebin", "ratio", "groups > 2 AND ratio > 5")))
_ADEQUACY = " UNION ALL ".join(_said("sensitive", "P0", r, "attr", e, "p", w) for r, e, w in (("nulls", "nulls", "round(nulls, 9) > 0.1"), ("one_group", "groups", "groups < 2")))
_QUALITY = " UNION ALL ".join(
    _said("quality", p, r, "'table'", "n", f"(SELECT {n} AS n FROM v_doc) q", "n > 0")
    for p, r, n in (
        ("P0", "missing_label", "count(*) - count(quality)"), ("P0", "missing_index", "count(*) - count(doc_id)"), ("P0", "repeated_index", "count(doc_id) - count(DISTINCT doc_id)"),
        ("P1", "missing_features", "5 * count(*) - count(lang) - count(source) - count(n_chars) - count(toxic) - count(y_pred)"), ("P1", "repeated_rows", "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM v_doc) u)"),
    )
)
_SLICES = "SELECT lang || '|' || source AS slice, count(*) AS n FROM v_doc WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1 HAVING count(*) < 30"
_ALL = " UNION ALL ".join((_ADEQUACY, _REPRESENTATION, _QUALITY, _said("representation", "P1", "small_slices", "'lang|source'", "n", f"(SELECT count(*) AS n FROM ({_SLICES}) s) q", "n > 0")))


def _hash(salt: str) -> str:
    return f"(CAST('0x' || substr(md5('{salt}:' || CAST(doc_id AS VARCHAR)), 1, 7) AS BIGINT) / 268435456.0)"


def oracle_sql() -> dict[str, str]:
    rules = f"WITH {_attrs(('lang', 'source'))}"
    score = "round(0.4 * f1 + 0.3 * recall + 0.2 * accuracy + 0.1 * auc, 6)"
    return {
        "knn_consistency": f"WITH {_near()} SELECT {_SUMMARY} FROM ({_consistent(5)}) c",
        "knn_consistency_by_group": f"WITH {_near(ASKED)} SELECT segment, {_SUMMARY} FROM ({_consistent(5)}) c GROUP BY 1",
        "knn_consistency_multi_k": f"WITH {_near(ASKED)} " + " UNION ALL ".join(f"SELECT {k} AS k, {_SUMMARY} FROM ({_consistent(k)}) c" for k in (5, 10, 20)),
        "cx_n3": f"WITH {_near()} SELECT round(CASE WHEN count(*) = 2 THEN avg(e) END, 6) AS n3 FROM (SELECT target, avg(CASE WHEN target <> o_target THEN 1.0 ELSE 0.0 END) AS e FROM near WHERE k = 1 GROUP BY 1) c",
        "cx_n2": f"WITH {_Z}, d AS (SELECT q.row_id, q.target, r.target AS o_target, min({_D}) AS dist FROM z q JOIN z r ON q.row_id <> r.row_id GROUP BY 1, 2, 3), r AS (SELECT target, sum(dist) FILTER (WHERE target = o_target) / (sum(dist) FILTER (WHERE target <> o_target) + 1e-12) AS r FROM d GROUP BY 1) SELECT round(CASE WHEN count(*) = 2 THEN avg(r / (1 + r)) END, 6) AS n2 FROM r",
        "cx_raug": f"WITH {_near()}, h AS (SELECT row_id, target, count(*) FILTER (WHERE target <> o_target) > 2 AS hit FROM near WHERE k <= 5 GROUP BY 1, 2), t AS (SELECT count(*) FILTER (WHERE target = 0) AS n0, count(*) FILTER (WHERE target = 1) AS n1, count(*) FILTER (WHERE target = 0 AND hit) AS h0, count(*) FILTER (WHERE target = 1 AND hit) AS h1 FROM h)"
        " SELECT round(h0 / CAST(greatest(n0, 1) AS DOUBLE), 6) AS majority, round(h1 / CAST(greatest(n1, 1) AS DOUBLE), 6) AS minority, round((h0 + n0 / CAST(greatest(n1, 1) AS DOUBLE) * h1) / (n0 / CAST(greatest(n1, 1) AS DOUBLE) + 1), 6) AS weighted FROM t",
        "rule_representation": f"{rules} {_REPRESENTATION}",
        "rule_sensitive_adequacy": f"WITH {_attrs(('lang', 'source', 'toxic'))} {_ADEQUACY}",
        "rule_data_quality": f"WITH one AS (SELECT 1 AS x) {_QUALITY}",
        "rules_all": f"{rules} {_ALL}",
        "triage_counts": f"{rules} SELECT category, priority, count(*) AS n FROM ({_ALL}) r GROUP BY 1, 2",
        "rule_readiness": f"{rules} SELECT CASE WHEN p0 > 0 THEN 'not_ready' WHEN p1 > 0 THEN 'with_caveats' ELSE 'ready' END AS status, p0, p1 FROM (SELECT count(*) FILTER (WHERE priority = 'P0') AS p0, count(*) FILTER (WHERE priority = 'P1') AS p1 FROM ({_ALL}) r) s",
        "low_support_intersections": _SLICES,
        "inject_missing_mcar": f"SELECT doc_id, CASE WHEN {_hash('n_chars')} >= 0.2 THEN n_chars END AS n_chars FROM v_doc",
        "inject_missing_mar": f"WITH w AS (SELECT *, CASE WHEN lang = 'en' THEN 2.0 ELSE 1.0 END AS w FROM v_doc) SELECT doc_id, lang, CASE WHEN {_hash('n_chars')} >= least(1.0, 0.2 * w / (SELECT avg(w) FROM w)) THEN n_chars END AS n_chars FROM w",
        "inject_duplicates": f"SELECT doc_id, lang, copy_no FROM v_doc, (VALUES (1), (2)) c(copy_no) WHERE copy_no = 1 OR {_hash('copy')} < 0.1",
        "mode_scores": f"SELECT *, CAST(rank() OVER (PARTITION BY model_type ORDER BY mean_score DESC) AS INTEGER) AS place FROM (SELECT variant, model_type, round(avg({score}), 6) AS mean_score, count(*) AS n FROM v_exp GROUP BY 1, 2) q",
        "stage_gap_deltas": """
SELECT dataset, binning AS stage, mean_gap, round(mean_gap - lag(mean_gap) OVER (PARTITION BY dataset ORDER BY binning), 9) AS change
FROM (SELECT dataset, binning, round(CAST(sum(CAST(round(gap * 10000) AS BIGINT)) AS DOUBLE) / (count(gap) * 10000), 9) AS mean_gap FROM v_exp GROUP BY 1, 2) q""",
        "before_after_best": "SELECT dataset, metric, b AS \"before\", a AS \"after\", round(a - b, 6) AS change FROM (" + " UNION ALL ".join(f"SELECT x.dataset, '{m}' AS metric, x.{m} AS a, y.{m} AS b FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY gap, experiment_id) AS r FROM v_exp WHERE mitigation <> 'baseline') x JOIN (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY experiment_id) AS r FROM v_exp WHERE mitigation = 'baseline') y ON x.dataset = y.dataset AND x.r = 1 AND y.r = 1" for m in ("f1", "recall", "gap")) + ") q",
        "experiment_summary": "SELECT count(*) AS experiments, count(DISTINCT dataset) AS datasets, count(DISTINCT model_type) AS models, count(DISTINCT binning) AS binnings, count(DISTINCT mitigation) AS mitigations FROM v_exp",
        "mitigation_gap_matrix": "SELECT mitigation, " + ", ".join(f"round(avg(CASE WHEN dataset = '{d}' THEN gap END), 6) AS gap_{d.lower()}" for d in "ANR") + " FROM v_exp GROUP BY 1",
    }
