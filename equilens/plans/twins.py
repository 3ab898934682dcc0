"""SQL twins of registered queries, one block each; `registry.oracle_sql` puts the views in front."""

from __future__ import annotations


def order(key: str, salt: str = "42") -> str:
    """The hash order of preparation.ranked."""
    return f"(CAST('0x' || substr(md5('{salt}:' || CAST({key} AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def rank(key: str, strata: str, salt: str = "42") -> str:
    return f"row_number() OVER ({f'PARTITION BY {strata}' if strata else ''} ORDER BY {order(key, salt)}, {key})"


AGE = (-1000, 1000, 3000, 5000, 7500, 10000)
COARSE = (-1000, 2500, 10000)


def bins(edges: tuple, value: str = "age_raw") -> str:
    first = f"WHEN {value} >= {edges[0]} AND {value} <= {edges[1]} THEN 0"
    rest = " ".join(f"WHEN {value} > {a} AND {value} <= {b} THEN {i}" for i, (a, b) in enumerate(zip(edges[1:], edges[2:]), 1))
    return f"CASE {first} {rest} END"


_GROUPS = """
g AS (
  SELECT patient, label, rows, {order} AS u
  FROM (SELECT patient, target AS label, sum(count(*)) OVER (PARTITION BY patient) AS rows, row_number() OVER (PARTITION BY patient ORDER BY count(*) DESC, target) AS k FROM v_group GROUP BY patient, target) q
  WHERE k = 1)"""
_DOC_TYPES = {"doc_id": "integer", "lang": "string", "source": "string", "n_chars": "integer", "quality": "integer", "toxic": "integer", "y_pred": "integer"}
_PROFILE = "c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS kind, count(DISTINCT {c}) AS n_unique, count({c}) AS present, count(*) AS n FROM v_doc" for c, k in _DOC_TYPES.items()) + ")"
_SIZES = "s AS (" + " UNION ALL ".join(f"SELECT '{a}' AS attr, CAST({a} AS VARCHAR) AS grp, count(*) AS n FROM v_doc WHERE {a} IS NOT NULL GROUP BY 2" for a in ("lang", "source")) + ")"
_CHI = """
o AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
r AS (SELECT a, sum(o) AS ra FROM o GROUP BY 1), k AS (SELECT b, sum(o) AS cb FROM o GROUP BY 1),
n AS (SELECT sum(o) AS n, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM o),
e AS (SELECT n.*, coalesce(o.o, 0) AS o, CAST(ra AS DOUBLE) * cb / n AS e FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN o ON o.a = r.a AND o.b = k.b),
d AS (SELECT *, CASE WHEN ka = 2 AND kb = 2 THEN abs(o - e) - least(0.5, abs(o - e)) ELSE abs(o - e) END AS d FROM e),
x AS (SELECT sum(d * d / e) AS chi, max(n) AS n, max(ka) AS ka, max(kb) AS kb FROM d)
SELECT round(chi, 4) AS chi2, CAST((ka - 1) * (kb - 1) AS BIGINT) AS dof, round(least(1.0, sqrt(chi / (n * greatest(least(ka, kb) - 1, 1)))), 6) AS cramers_v, CAST(n AS BIGINT) AS n FROM x"""
_DRIFT = """
v AS (SELECT value, count(*) FILTER (WHERE event_type = 'click') AS x, count(*) FILTER (WHERE event_type = 'view') AS y FROM v_drift WHERE event_type IN ('click', 'view') AND value IS NOT NULL GROUP BY 1),
f AS (SELECT *, sum(x) OVER w AS fx, sum(y) OVER w AS fy, sum(x) OVER () AS nx, sum(y) OVER () AS ny FROM v WINDOW w AS (ORDER BY value))"""
_BIN_RATES = f"b AS (SELECT {bins(AGE)} AS bin, count(*) AS n, sum(target) AS pos, CAST(sum(target) AS DOUBLE) / count(*) AS rate FROM v_age GROUP BY 1 HAVING bin IS NOT NULL)"
_SCORE = "round(0.4 * f1 + 0.3 * recall + 0.2 * accuracy + 0.1 * auc, 6)"


def _stats(bin_sql: str, where: str = "bin IS NOT NULL") -> str:
    return f"""
SELECT bin, count(*) AS n, round(avg(target), 6) AS rate, min(age_raw) AS low, max(age_raw) AS high, round(count(*) / CAST((SELECT count(*) FROM v_age) AS DOUBLE), 6) AS share
FROM (SELECT *, {bin_sql} AS bin FROM v_age{', q' if 'q1' in bin_sql else ''}) t WHERE {where} GROUP BY 1"""


def _compare(name: str, edges: tuple) -> str:
    return f"SELECT '{name}' AS strategy, {bins(edges)} AS bin, target FROM v_age"


def oracle_sql() -> dict[str, str]:
    outliers = "(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))"
    return {
        "split_stratified": f"""
SELECT row_id, CASE WHEN r <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split
FROM (SELECT row_id, {rank('row_id', 'target, sex')} AS r, count(*) OVER (PARTITION BY target, sex) AS n FROM v_age) q""",
        "split_grouped": f"""
WITH {_GROUPS.format(order=order('patient'))}, t AS (SELECT patient, row_number() OVER (PARTITION BY label ORDER BY u, patient) AS r, count(*) OVER (PARTITION BY label) AS n FROM g)
SELECT row_id, CASE WHEN r <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM v_group JOIN t USING (patient)""",
        "split_group_stratified": f"""
WITH {_GROUPS.format(order=order('patient'))}, t AS (SELECT patient, sum(rows) OVER (PARTITION BY label ORDER BY u) - rows AS upto, sum(rows) OVER (PARTITION BY label) AS n FROM g)
SELECT row_id, CASE WHEN upto < n * 0.2::DOUBLE THEN 'test' ELSE 'train' END AS split FROM v_group JOIN t USING (patient)""",
        "folds_stratified": f"SELECT row_id, CAST(({rank('row_id', 'target')} - 1) % 5 AS INTEGER) AS fold FROM v_age",
        "mit_rus": f"SELECT row_id, target FROM (SELECT row_id, target, {rank('row_id', 'target')} AS r FROM v_age) q WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM v_age GROUP BY target) c)",
        "mit_ros": f"""
WITH c AS (SELECT target, count(*) AS n, max(count(*)) OVER () AS m FROM v_age GROUP BY 1), r AS (SELECT row_id, target, {rank('row_id', 'target')} AS r FROM v_age)
SELECT row_id, target, CAST(unnest(range(m // n + CASE WHEN r <= m % n THEN 1 ELSE 0 END)) AS INTEGER) AS _copy FROM r JOIN c USING (target)""",
        "sample_stable": f"SELECT row_id, target FROM v_age ORDER BY {order('row_id')}, row_id LIMIT 200",
        "sample_stratified": f"""
SELECT row_id, sex FROM (SELECT row_id, sex, {rank('row_id', 'sex')} AS r, count(*) OVER (PARTITION BY sex) AS n, count(*) OVER () AS a FROM v_age) q WHERE r <= round(500.0::DOUBLE * n / a)""",
        "sample_near_threshold": f"SELECT row_id, y_proba FROM v_pred WHERE round(abs(y_proba - 0.5), 9) < 0.1 ORDER BY {order('row_id')}, row_id LIMIT 50",
        "sample_cells": f"""
WITH o AS (SELECT *, CASE WHEN y_true = 1 AND y_pred = 1 THEN 'TP' WHEN y_pred = 1 THEN 'FP' WHEN y_true = 0 THEN 'TN' ELSE 'FN' END AS outcome FROM v_pred),
c AS (SELECT row_id, 0 AS i, 'grp_a' AS attr, grp_a AS grp, outcome FROM o UNION ALL SELECT row_id, 1, 'grp_b', grp_b, outcome FROM o),
p AS (SELECT *, {rank('row_id', 'attr, grp, outcome')} AS r FROM c),
d AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY i) AS k FROM p WHERE r <= 4)
SELECT row_id, attr, grp, outcome FROM d WHERE k = 1 ORDER BY i, grp, outcome, r LIMIT 100""",
        "mit_extend_sensitive": f"""
WITH n AS (SELECT row_id, sex, {rank('row_id', '')} - 1 AS place FROM v_age), w AS (SELECT row_id, floor({order('row_id', 'extend')} * (SELECT count(*) FROM v_age)) AS place FROM v_age WHERE row_id % 10 = 0)
SELECT w.row_id, sex FROM w JOIN n USING (place)""",
        "encode_labels": "SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS lang_code FROM v_doc WHERE lang IS NOT NULL",
        "impute_profile": "SELECT doc_id, coalesce(CAST(quality AS DOUBLE), (SELECT quantile_cont(CAST(quality AS DOUBLE), 0.5) FROM v_doc)) AS quality, lang FROM v_doc",
        "impute_fit_apply": "SELECT doc_id, coalesce(CAST(quality AS DOUBLE), (SELECT quantile_cont(CAST(quality AS DOUBLE), 0.5) FROM v_doc WHERE doc_id % 2 = 0)) AS quality, lang FROM v_doc",
        "fold_preprocess": """
WITH f AS (SELECT doc_id, n_chars, quality, k, doc_id % 3 = k AS tested FROM v_doc, range(3) r(k)),
m AS (SELECT k, quantile_cont(n_chars, 0.5) AS a, quantile_cont(quality, 0.5) AS b FROM f WHERE NOT tested GROUP BY 1),
s AS (SELECT f.k, avg(coalesce(n_chars, a)) AS ma, stddev_pop(coalesce(n_chars, a)) AS sa, avg(coalesce(quality, b)) AS mb, stddev_pop(coalesce(quality, b)) AS sb FROM f JOIN m USING (k) WHERE NOT tested GROUP BY 1)
SELECT CAST(k AS INTEGER) AS fold_no, CASE WHEN tested THEN 'test' ELSE 'train' END AS side, doc_id, round((coalesce(n_chars, a) - ma) / sa, 6) AS n_chars, round((coalesce(quality, b) - mb) / sb, 6) AS quality
FROM f JOIN m USING (k) JOIN s USING (k)""",
        "missing_rows": """
WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE doc_id IS NULL OR lang IS NULL OR source IS NULL OR n_chars IS NULL OR quality IS NULL OR toxic IS NULL OR y_pred IS NULL) AS incomplete FROM v_doc)
SELECT n, incomplete, n - incomplete AS complete, CASE WHEN incomplete / CAST(n AS DOUBLE) < 0.05 THEN 'drop_rows' WHEN incomplete / CAST(n AS DOUBLE) < 0.5 THEN 'impute' ELSE 'drop_column' END AS action FROM t""",
        "representation_balance": f"""
WITH {_SIZES}
SELECT attr, count(*) AS groups, min(n) AS least, max(n) AS most, round(max(n) / CAST(min(n) AS DOUBLE), 6) AS size_ratio, round(stddev_samp(n) / avg(n), 6) AS cv FROM s GROUP BY 1""",
        "column_profile": f"""
WITH {_PROFILE}
SELECT "column", kind, n_unique, present, n - present AS n_missing, round(n_unique / CAST(greatest(present, 1) AS DOUBLE), 6) AS distinct_ratio, n_unique = n AS all_unique FROM c""",
        "semantic_type": f"""
WITH {_PROFILE}
SELECT "column", n_unique, CASE WHEN "column" = 'doc_id' THEN 'identifier' WHEN n_unique = 2 THEN 'binary' WHEN kind = 'integer' AND (n_unique <= 12 OR n_unique / CAST(present AS DOUBLE) < 0.05) THEN 'categorical'
  WHEN kind = 'integer' THEN 'continuous' WHEN n_unique <= 20 THEN 'categorical' ELSE 'text' END AS semantic_type
FROM c""",
        "numeric_distribution": """
SELECT 'age_raw' AS "column", count(*) AS n, min(age_raw) AS "min", round(quantile_cont(age_raw, 0.25), 4) AS q1, round(quantile_cont(age_raw, 0.5), 4) AS median, round(quantile_cont(age_raw, 0.75), 4) AS q3,
  max(age_raw) AS "max", round(avg(age_raw), 4) AS mean, round(stddev_pop(age_raw), 4) AS std
FROM v_age WHERE age_raw IS NOT NULL""",
        "numeric_histogram": """
SELECT CAST(least(floor((n_chars - lo) / ((hi - lo) / 10.0::DOUBLE)), 9) AS BIGINT) AS bin, count(*) AS n FROM v_doc, (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM v_doc) b WHERE n_chars IS NOT NULL GROUP BY 1""",
        "categorical_distribution": """
WITH c AS (SELECT source AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS r FROM v_doc WHERE source IS NOT NULL GROUP BY 1),
b AS (SELECT value, n FROM c WHERE r <= 12 UNION ALL SELECT '(other)', CAST(coalesce(sum(n), 0) AS BIGINT) FROM c WHERE r > 12)
SELECT value, n, round(n / CAST((SELECT count(*) FROM v_doc) AS DOUBLE), 6) AS share FROM b""",
        "outlier_counts": f"""
WITH b AS (SELECT lang, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3, avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM v_doc GROUP BY 1)
SELECT lang, count(v) AS n, count(*) FILTER (WHERE {outliers}) AS iqr_outliers, count(*) FILTER (WHERE abs(v - m) > 3 * s) AS z_outliers
FROM (SELECT lang, CAST(n_chars AS DOUBLE) AS v FROM v_doc) d JOIN b USING (lang) GROUP BY 1""",
        "correlation_matrix": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM v_pred" for a, b in (("y_true", "y_proba"), ("y_true", "y_pred"), ("y_proba", "y_pred"))),
        "dominant_category": f"""
WITH {_SIZES}
SELECT attr, arg_max(grp, (n, grp)) AS grp, round(max(n) / CAST((SELECT count(*) FROM v_doc) AS DOUBLE), 6) AS share, round(max(n) / CAST((SELECT count(*) FROM v_doc) AS DOUBLE), 6) > 0.65 AS dominant FROM s GROUP BY 1""",
        "issue_flags": """
SELECT 'sex' AS attr, round(max(n) / CAST(min(n) AS DOUBLE), 6) > 3 AS size_issue, round(max(r) - min(r), 6) > 0.15 AS rate_issue FROM (SELECT sex, count(*) AS n, avg(target) AS r FROM v_age WHERE sex IS NOT NULL GROUP BY 1) q""",
        "bin_fairness": f"""
WITH {_BIN_RATES}
SELECT count(*) AS bins, min(n) AS least, max(n) AS most, round(stddev_samp(n) / avg(n), 6) AS cv, round(max(rate) - min(rate), 6) AS gap, round(CASE WHEN max(rate) > 0 THEN min(rate) / max(rate) END, 6) AS dp_ratio,
  round(max(abs(rate - (SELECT CAST(sum(pos) AS DOUBLE) / sum(n) FROM b))), 6) AS max_deviation
FROM b""",
        "bin_disparity": f"""
WITH {_BIN_RATES}, d AS (SELECT arg_max(bin, (rate, bin)) AS highest, arg_min(bin, (rate, bin)) AS lowest, max(rate) AS hi, min(rate) AS lo FROM b)
SELECT highest, lowest, round(hi, 6) AS hi, round(lo, 6) AS lo, round(hi / lo, 6) AS ratio, CASE WHEN hi / lo >= 3 THEN 'P0' WHEN hi / lo >= 1.5 THEN 'P1' END AS priority FROM d""",
        "bin_compare_strategies": f"""
WITH x AS ({_compare('fine', AGE)} UNION ALL {_compare('coarse', COARSE)}), t AS (SELECT strategy, bin, count(*) AS n, avg(target) AS rate FROM x WHERE bin IS NOT NULL GROUP BY 1, 2),
s AS (SELECT strategy, count(*) AS bins, min(n) / avg(n) AS a, coalesce(stddev_samp(n) / avg(n), 0) AS cv, max(rate) - min(rate) AS gap FROM t GROUP BY 1)
SELECT strategy, bins, round(cv, 6) AS cv, round(gap, 6) AS gap, round((a + greatest(0, 1 - cv) + greatest(0, 1 - gap / 0.5)) / 3, 6) AS score FROM s""",
        "bin_quantile": f"""
WITH q AS (SELECT min(age_raw) AS q0, quantile_cont(age_raw, 0.25) AS q1, quantile_cont(age_raw, 0.5) AS q2, quantile_cont(age_raw, 0.75) AS q3, max(age_raw) AS q4 FROM v_age)
{_stats(bins(('q0', 'q1', 'q2', 'q3', 'q4')))}""",
        "topk_tiered": f"""
WITH s AS (SELECT *, {_SCORE} AS score, CASE WHEN recall >= 0.7 AND gap <= 0.1 THEN 1 WHEN recall >= 0.6 AND gap <= 0.1 THEN 2 ELSE 3 END AS tier FROM v_exp)
SELECT dataset, CAST(r AS INTEGER) AS rank, tier, experiment_id, score FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY tier, score DESC, gap, experiment_id) AS r FROM s) q WHERE r <= 3""",
        "rank_metric_difficulty": """
WITH m AS (SELECT dataset, metric, round(avg(v), 9) AS v FROM (SELECT dataset, 'f1' AS metric, f1 AS v FROM v_exp UNION ALL SELECT dataset, 'recall', recall FROM v_exp UNION ALL SELECT dataset, 'gap', gap FROM v_exp) q GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY v DESC) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0 AS rank FROM m)
SELECT dataset, round(avg(rank), 4) AS mean_rank FROM r GROUP BY 1""",
        "set_overlap_matrix": """
WITH k AS (SELECT DISTINCT 'a' AS s, k1, k2, k3 FROM v_lineage_a UNION ALL SELECT DISTINCT 'b', k1, k2, k3 FROM v_lineage_b),
p AS (SELECT x.s AS a, y.s AS b, count(*) AS shared FROM k x JOIN k y ON x.k1 IS NOT DISTINCT FROM y.k1 AND x.k2 IS NOT DISTINCT FROM y.k2 AND x.k3 IS NOT DISTINCT FROM y.k3 GROUP BY 1, 2)
SELECT a, b, shared, round(100 * shared / CAST(max(shared) FILTER (WHERE a = b) OVER (PARTITION BY a) AS DOUBLE), 4) AS pct_of_a FROM p""",
        "test_chi2": f"WITH {_CHI.format(a='lang', b='y_pred', source='v_doc')}",
        "cramers_v": f"WITH {_CHI.format(a='grp_a', b='y_true', source='v_pred')}",
        "test_ks": f"WITH {_DRIFT} SELECT round(max(abs(fx / CAST(nx AS DOUBLE) - fy / CAST(ny AS DOUBLE))), 6) AS ks, CAST(max(nx) AS BIGINT) AS n_a, CAST(max(ny) AS BIGINT) AS n_b FROM f",
        "test_mann_whitney": f"""
WITH {_DRIFT}, u AS (SELECT sum(x * (fy - y + y / 2.0::DOUBLE)) AS u, CAST(sum(x) AS BIGINT) AS n_a, CAST(sum(y) AS BIGINT) AS n_b FROM f)
SELECT round(u, 1) AS u, n_a, n_b, round(u / (CAST(n_a AS DOUBLE) * n_b), 6) AS effect FROM u""",
        "cx_f2_f3_f4": """
WITH r AS (SELECT min(age_raw) FILTER (WHERE target = 0) AS l0, max(age_raw) FILTER (WHERE target = 0) AS h0, min(age_raw) FILTER (WHERE target = 1) AS l1, max(age_raw) FILTER (WHERE target = 1) AS h1 FROM v_age),
b AS (SELECT greatest(l0, l1) AS a, least(h0, h1) AS b, greatest(h0, h1) - least(l0, l1) AS w FROM r), s AS (SELECT count(*) FILTER (WHERE age_raw BETWEEN a AND b) / CAST(count(*) AS DOUBLE) AS s FROM v_age, b)
SELECT round(CASE WHEN w > 0 THEN greatest(0, b - a) / w ELSE 1 END, 6) AS f2, round(s, 6) AS f3, round(s, 6) AS f4 FROM b, s""",
        "scalar_functions": """
SELECT doc_id, CASE WHEN lang LIKE '%e%' OR lang LIKE '%x%' THEN 1 ELSE 0 END AS has_e, upper(source[1:1]) || source[2:] AS title, CASE WHEN n_chars IS NOT NULL THEN greatest(0.0, least(1.0, n_chars / 1000.0::DOUBLE)) END AS clipped,
  lang AS attr, TRY_CAST(replace(source, 'src', '') AS DOUBLE) AS source_no, source AS base
FROM v_doc""",
        "gated_fairness_report": """
WITH u AS (SELECT 'segment' AS attr, segment AS grp, y_true, y_pred FROM v_pred_gated UNION ALL SELECT 'priority', priority, y_true, y_pred FROM v_pred_gated),
c AS (SELECT attr, grp, count(*) AS n, avg(y_pred) AS positive_rate, coalesce(avg(y_pred) FILTER (WHERE y_true = 1), 0) AS tpr, coalesce(avg(y_pred) FILTER (WHERE y_true = 0), 0) AS fpr, sum(y_true) AS p FROM u WHERE grp IS NOT NULL GROUP BY ALL),
s AS (SELECT *, CASE WHEN n < 50 THEN 'undersized' WHEN p = 0 OR p = n THEN 'degenerate' WHEN grp = 'unknown' THEN 'unknown' ELSE 'compared' END AS status FROM c),
g AS (SELECT attr, max(positive_rate) - min(positive_rate) AS dp, max(tpr) - min(tpr) AS tp, max(fpr) - min(fpr) AS fp FROM s WHERE status = 'compared' GROUP BY 1 HAVING count(*) >= 2)
SELECT attr, grp, n, status, round(positive_rate, 6) AS positive_rate, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(dp, 6) AS dp_gap, round(tp, 6) AS tpr_gap, round(fp, 6) AS fpr_gap FROM s LEFT JOIN g USING (attr)""",
    }
