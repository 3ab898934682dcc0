"""Queries that describe tables and their columns, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.operators import columns as C
from equilens.operators import profiling as D
from equilens.sources.tables import view

Query = Callable[[SparkSession, str], DataFrame]
COLUMNS = ("doc_id", "lang", "source", "n_chars", "quality", "toxic", "y_pred")
KINDS = {"doc_id": "integer", "lang": "string", "source": "string", "n_chars": "integer", "quality": "integer", "toxic": "integer", "y_pred": "integer"}
#: Quantiles of complexity measures in the literature.
LITERATURE = {"F2": (0.0, 0.02, 0.05, 0.15, 1.0), "N3": (0.0, 0.15, 0.25, 0.35, 1.0), "T1": (0.0, 0.05, 0.15, 0.3, 1.0)}


def _history(df: DataFrame) -> DataFrame:
    """Values of past runs: the gaps and errors of experiments, and a measure with one value only."""
    return df.select(F.inline(F.array(F.struct(F.lit("F2").alias("metric"), F.col("gap").alias("value")), F.struct(F.lit("N3").alias("metric"), (1 - F.col("f1")).alias("value"))))).unionByName(
        df.agg(F.lit("T1").alias("metric"), F.max("recall").alias("value"))
    )


def _against(df: DataFrame) -> DataFrame:
    values = df.groupBy(F.when(F.col("dataset") == "R", "F2").when(F.col("dataset") == "A", "N3").otherwise("T1").alias("metric")).agg(F.round(F.max("gap"), 6).alias("value"))
    return C.against_reference(values, C.reference_quantiles(_history(df), LITERATURE))


def _scaled_shift(df: DataFrame) -> DataFrame:
    after = df.select(F.sqrt(F.col("f1")).alias("f1"), F.col("f2"))
    return C.shift_rank(df.select("f1", "f2"), after, ["f1", "f2"])


def queries() -> dict[str, Query]:
    def on(name: str, op: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: op(view(spark, sf_dir, name))

    doc, clinic, runs, exp = (lambda op, n=n: on(n, op) for n in ("v_doc", "v_clinic", "v_runs", "v_exp"))
    types = lambda d: C.triage_column_type(D.column_profile(d), C.date_columns(d))
    listed = lambda t: t.withColumn("counts", F.array_join(F.col("counts").cast("array<string>"), ","))
    return {
        "basic_stats": doc(lambda d: C.basic_stats(d, "quality")),
        "inferred_type": doc(lambda d: C.inferred_type(D.column_profile(d))),
        "triage_column_type": doc(types),
        "column_role": clinic(lambda d: C.column_role(types(d), d.columns[-1], {"cp": "sensitive"})),
        "role_guess": clinic(lambda d: C.role_guess(D.column_profile(d), d.columns)),
        "sensitive_candidate": clinic(lambda d: C.described(d).select("column", "score")),
        "binning_guidance": clinic(lambda d: listed(C.described(d).select("column", "binnable", "guidance", "counts"))),
        "quality_issue_columns": doc(lambda d: C.quality_issues(D.column_profile(d.withColumn("same", F.lit(1))), ["lang"])),
        "role_validation": clinic(lambda d: C.role_validation(D.semantic_type(D.column_profile(d)), {"row_id": "index", "age": "sensitive", "gender": "sensitive", "diagnosis": "target"})),
        "feature_distributions": doc(lambda d: C.feature_distributions(d.select("lang", "quality", "n_chars"))),
        "dataset_characterize": doc(lambda d: C.dataset_characterize(d, "quality")),
        "upload_profile": doc(C.upload_profile),
        "dataset_summary": doc(lambda d: C.dataset_summary(d, "lang", ["quality", "source"])),
        "compare_profiles": doc(lambda d: C.compare_profiles(d, "lang", "quality")),
        "profile_rows": doc(lambda d: C.distribution_rows(d, "lang", ["source", "toxic"])),
        "distribution_difference": doc(lambda d: C.distribution_difference(d, "lang", ["source", "toxic"])),
        "split_verification": runs(lambda d: C.split_verification(d, "split", ["line", "part", "y_true"])),
        "duplicate_row_ids": doc(lambda d: C.duplicate_row_ids(d.select("doc_id", "lang", "source", "n_chars"), "doc_id")),
        "drift_matrix": runs(lambda d: C.drift_matrix(d, "dataset", "N", ["y_proba", "small"])),
        "shift_rank": on("v_knn", _scaled_shift),
        "missing_rate_report": doc(C.missing_rate_report),
        "limitations": doc(lambda d: C.limitations(D.column_profile(d), [], ["lang", "doc_id"])),
        "reference_quantiles": exp(lambda d: C.reference_quantiles(_history(d), LITERATURE)),
        "join_history_reference": exp(_against),
    }


def _profile(source: str, columns: dict[str, str]) -> str:
    """CTE c: (column, kind, u distinct, p present, n rows)."""
    one = 'SELECT \'{c}\' AS "column", \'{k}\' AS kind, count(DISTINCT {c}) AS u, count({c}) AS p, count(*) AS n FROM {s}'
    return "c AS (" + " UNION ALL ".join(one.format(c=c, k=k, s=source) for c, k in columns.items()) + ")"


_CLINIC = {
    "row_id": "integer", "age": "string", "sex": "integer", "gender": "string", "diagnosis": "string", "chol": "integer", "cholesterol": "integer",
    "pain": "string", "cp": "integer", "thal": "integer", "trestbps": "integer", "oldpeak": "float", "site": "integer", "segment": "string",
}
_SEMANTIC = """
t AS (
  SELECT *, CASE WHEN u / CAST(greatest(p, 1) AS DOUBLE) >= 0.98 AND ("column" LIKE '%\\_id' ESCAPE '\\' OR "column" IN ('id', 'key', 'uuid', 'index')) THEN 'identifier' WHEN u = 2 THEN 'binary'
    WHEN kind <> 'string' AND (u <= 12 OR round(u / CAST(greatest(p, 1) AS DOUBLE), 6) < 0.05) THEN 'categorical' WHEN kind <> 'string' THEN 'continuous' WHEN u <= 20 THEN 'categorical' ELSE 'text' END AS semantic_type
  FROM c)"""
_GUIDED = """
g AS (
  SELECT *, CASE WHEN semantic_type = 'binary' THEN 'use_directly' WHEN semantic_type = 'identifier' THEN 'avoid' WHEN kind <> 'string' AND 100.0 * (n - p) / n >= 50 THEN 'caution'
    WHEN kind <> 'string' AND u BETWEEN 3 AND 5 THEN 'limited_bins' WHEN kind <> 'string' AND u < 20 THEN 'ok_for_binning' WHEN kind <> 'string' THEN 'great_for_binning'
    WHEN semantic_type = 'categorical' THEN 'use_directly' ELSE 'avoid' END AS guidance
  FROM t),
b AS (
  SELECT *, list_filter([2, 5, 10], lambda k: u % k = 0 AND k <= u) AS even, list_filter([2, 5, 10], lambda k: u % k <> 0 AND k <= u) AS odd FROM g)"""
_SCORE = """round(CASE WHEN guidance = 'avoid' THEN least(s, 0.1) ELSE s END, 2)"""
_SCORED = """
z AS (
  SELECT *, CASE WHEN regexp_matches("column", 'age|sex|gender|race|ethnic|religion|disab|marital|country|national') THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN semantic_type IN ('binary', 'categorical') THEN 0.2::DOUBLE WHEN semantic_type = 'continuous' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS s
  FROM g)"""
_TYPE = """
CASE WHEN u = 0 THEN 'unknown' WHEN u >= 0.99 * n AND n > 10 THEN 'identifier' WHEN u = 2 THEN 'binary' WHEN u <= 20 THEN 'categorical' WHEN kind <> 'string' THEN 'numerical' ELSE 'text' END"""


def _rows(source: str, by: str, attrs: tuple[str, ...]) -> str:
    """CTE r: groups of each dataset with their share."""
    u = " UNION ALL ".join(f"SELECT {by}, '{a}' AS attr, CAST({a} AS VARCHAR) AS grp FROM {source} WHERE {a} IS NOT NULL" for a in attrs)
    return f"""
r AS (
  SELECT {by}, attr, grp, n, round(n / sum(n) OVER (PARTITION BY {by}, attr), 6) AS share, round(n / sum(n) OVER (PARTITION BY {by}, attr), 9) < 0.1 AS under_tenth
  FROM (SELECT {by}, attr, grp, CAST(count(*) AS DOUBLE) AS n FROM ({u}) u GROUP BY ALL) q)"""


def _ks(samples: str, keys: str) -> str:
    """CTE k: the largest distance of the two distribution functions, from (keys, value, ref)."""
    return f"""
s AS ({samples}),
v AS (SELECT {keys}, value, count(*) FILTER (WHERE ref) AS x, count(*) FILTER (WHERE NOT ref) AS y FROM s GROUP BY ALL),
f AS (SELECT {keys}, sum(x) OVER w AS fx, sum(y) OVER w AS fy, sum(x) OVER (PARTITION BY {keys}) AS nx, sum(y) OVER (PARTITION BY {keys}) AS ny FROM v WINDOW w AS (PARTITION BY {keys} ORDER BY value)),
k AS (SELECT {keys}, max(abs(fx / CAST(nx AS DOUBLE) - fy / CAST(ny AS DOUBLE))) AS d, CAST(max(nx) AS DOUBLE) AS nx, CAST(max(ny) AS DOUBLE) AS ny FROM f GROUP BY ALL)"""


_HISTORY = "h AS (SELECT 'F2' AS metric, gap AS value FROM v_exp UNION ALL SELECT 'N3', 1 - f1 FROM v_exp)"
_QUANTILES = f"""
{_HISTORY},
q AS (
  SELECT metric, 'history' AS source, round(min(value), 6) AS "min", round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS "max"
  FROM h GROUP BY 1 UNION ALL SELECT 'T1', 'literature', 0.0, 0.05, 0.15, 0.3, 1.0)"""


def oracle_sql() -> dict[str, str]:
    doc, clinic = _profile("v_doc", KINDS), _profile("v_clinic", _CLINIC)
    described = f"WITH {doc}, {_SEMANTIC}, {_GUIDED}, {_SCORED}"
    drift = " UNION ALL ".join(
        f"SELECT d AS dataset, '{f}' AS feature, {f} AS value, r.dataset = 'N' AS ref FROM v_runs r JOIN (VALUES ('A'), ('R')) o(d) ON r.dataset IN (d, 'N')" for f in ("y_proba", "small")
    )
    scaled = "round((value - min(value) OVER (PARTITION BY feature, ref)) / (max(value) OVER (PARTITION BY feature, ref) - min(value) OVER (PARTITION BY feature, ref)), 9)"
    moved = "SELECT 'f1' AS feature, f1 AS value, true AS ref FROM v_knn UNION ALL SELECT 'f2', f2, true FROM v_knn UNION ALL SELECT 'f1', sqrt(f1), false FROM v_knn UNION ALL SELECT 'f2', f2, false FROM v_knn"
    sizes = "SELECT 'size' AS section, 'rows' AS item, CAST(count(*) AS DOUBLE) AS value FROM v_doc UNION ALL SELECT 'size', 'columns', 7 UNION ALL SELECT 'size', 'prevalence', round(avg(quality), 6) FROM v_doc"
    return {
        "basic_stats": "SELECT count(*) AS rows, 7 AS columns, round(avg(quality), 6) AS prevalence FROM v_doc",
        "inferred_type": f"""WITH {doc} SELECT "column", CASE WHEN u = 0 THEN 'unknown' WHEN u = 2 THEN 'binary' WHEN kind <> 'string' THEN 'numerical' WHEN u <= 20 THEN 'categorical' ELSE 'text' END AS inferred FROM c""",
        "triage_column_type": f'WITH {doc} SELECT "column", {_TYPE} AS type FROM c',
        "column_role": f"""
WITH {clinic}, y AS (SELECT "column", {_TYPE} AS type FROM c)
SELECT "column", type, CASE WHEN "column" = 'cp' THEN 'sensitive' WHEN type = 'identifier' THEN 'identifier' WHEN "column" = 'diagnosis' THEN 'label' WHEN "column" IN ('age', 'sex', 'gender') THEN 'sensitive'
  WHEN "column" = 'segment' AND type = 'binary' THEN 'label' ELSE 'feature' END AS role
FROM y""",
        "role_guess": """SELECT 'diagnosis' AS target, 'row_id' AS "index" FROM v_clinic LIMIT 1""",
        "sensitive_candidate": f'WITH {clinic}, {_SEMANTIC}, {_GUIDED}, {_SCORED} SELECT "column", {_SCORE} AS score FROM z',
        "binning_guidance": f"""
WITH {clinic}, {_SEMANTIC}, {_GUIDED}
SELECT "column", guidance IN ('caution', 'limited_bins', 'ok_for_binning', 'great_for_binning') AS binnable, guidance,
  CASE semantic_type WHEN 'binary' THEN '2' WHEN 'categorical' THEN CASE WHEN len(even) > 0 THEN array_to_string(even, ',') WHEN u > 1 AND u <= 10 THEN CAST(u AS VARCHAR) ELSE '' END
    WHEN 'continuous' THEN array_to_string(list_concat(even, odd), ',') ELSE '' END AS counts
FROM b""",
        "quality_issue_columns": f"""
WITH {_profile("(SELECT *, 1 AS same FROM v_doc) w", KINDS | {"same": "integer"})}
SELECT "column", 'high_missing' AS issue FROM c WHERE n - p >= greatest(1, floor(n * 0.2)) UNION ALL SELECT "column", 'low_unique' FROM c WHERE u <= 1
UNION ALL SELECT "column", 'unconfirmed_role' FROM c WHERE "column" <> 'lang'""",
        "role_validation": f"""
WITH {clinic}, {_SEMANTIC}
SELECT "column", CASE "column" WHEN 'row_id' THEN 'index' WHEN 'diagnosis' THEN 'target' ELSE 'sensitive' END AS role, "column" = 'row_id' OR semantic_type <> 'text' AS accepted
FROM t WHERE "column" IN ('row_id', 'age', 'gender', 'diagnosis')""",
        "feature_distributions": f"""
WITH c AS (SELECT 'lang' AS "column", 'string' AS kind, count(DISTINCT lang) AS u, count(lang) AS p FROM v_doc UNION ALL SELECT 'quality', 'integer', count(DISTINCT quality), count(quality) FROM v_doc UNION ALL SELECT 'n_chars', 'integer', count(DISTINCT n_chars), count(n_chars) FROM v_doc),
{_SEMANTIC},
l AS (SELECT 'lang' AS "column", lang AS name, NULL::DOUBLE AS v FROM v_doc WHERE lang IS NOT NULL UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), quality FROM v_doc WHERE quality IS NOT NULL UNION ALL SELECT 'n_chars', CAST(n_chars AS VARCHAR), n_chars FROM v_doc WHERE n_chars IS NOT NULL),
o AS (SELECT "column", name, count(*) AS n FROM l JOIN t USING ("column") WHERE semantic_type IN ('binary', 'categorical') GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, name) <= 12),
s AS (SELECT "column", min(v) AS "min", round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q3, max(v) AS "max", round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std
  FROM l JOIN t USING ("column") WHERE semantic_type = 'continuous' GROUP BY 1)
SELECT "column", 'value' AS part, name, CAST(n AS DOUBLE) AS value FROM o
UNION ALL SELECT "column", 'quantile', name, value FROM s UNPIVOT (value FOR name IN ("min", q1, median, q3, "max", mean, std))""",
        "dataset_characterize": f"""
{described}
{sizes} UNION ALL SELECT 'class', coalesce(CAST(quality AS VARCHAR), 'missing'), count(*) FROM v_doc GROUP BY 2
UNION ALL SELECT 'duplicates', 'rows', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM v_doc) w) FROM v_doc
UNION ALL SELECT 'missing', "column", n - p FROM c UNION ALL SELECT 'distinct', "column", u FROM c UNION ALL SELECT 'sensitive', "column", {_SCORE} FROM z""",
        "upload_profile": f'{described} SELECT "column", kind, semantic_type, u AS n_unique, n - p AS n_missing, n AS n_rows FROM z',
        "dataset_summary": "SELECT lang, count(*) AS rows, 6 AS columns, 6 * count(*) - count(doc_id) - count(source) - count(n_chars) - count(quality) - count(toxic) - count(y_pred) AS missing, count(quality) > 0 AND count(source) > 0 AS has_required FROM v_doc GROUP BY 1",
        "compare_profiles": "SELECT lang, count(*) AS rows, round(avg(quality), 6) AS prevalence, round(count(*) / CAST((SELECT count(*) FROM v_doc) AS DOUBLE), 6) AS share FROM v_doc GROUP BY 1",
        "profile_rows": f"WITH {_rows('v_doc', 'lang', ('source', 'toxic'))} SELECT lang, attr, grp, CAST(n AS BIGINT) AS n, share, under_tenth FROM r",
        "distribution_difference": f"""
WITH {_rows('v_doc', 'lang', ('source', 'toxic'))},
d AS (SELECT attr, round(max(CASE WHEN k < (SELECT count(DISTINCT lang) FROM v_doc) THEN hi ELSE hi - lo END), 6) AS difference
  FROM (SELECT attr, grp, max(share) AS hi, min(share) AS lo, count(*) AS k FROM r GROUP BY ALL) q GROUP BY 1)
SELECT attr, difference, CASE WHEN difference < 0.05 THEN 'similar' WHEN difference < 0.15 THEN 'minor' ELSE 'different' END AS label FROM d""",
        "split_verification": f"""
WITH {_rows('v_runs', 'split', ('line', 'part', 'y_true'))},
p AS (SELECT attr, grp, coalesce(max(share) FILTER (WHERE split = 'train'), 0) AS train_share, coalesce(max(share) FILTER (WHERE split = 'test'), 0) AS test_share FROM r GROUP BY ALL)
SELECT *, round(abs(train_share - test_share), 6) AS difference FROM p""",
        "duplicate_row_ids": "SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY lang, source, n_chars) AS k FROM v_doc) q WHERE k > 1 ORDER BY doc_id LIMIT 1000",
        "drift_matrix": f"""
WITH {_ks(drift, "dataset, feature")},
p AS (SELECT *, sqrt(nx * ny / (nx + ny)) * d AS t FROM k),
o AS (SELECT dataset, feature, d, round(CASE WHEN t < 0.2 THEN 1 ELSE greatest(0, least(1, 2 * list_sum([CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * i * i * t * t) FOR i IN range(1, 31)]))) END, 6) AS p FROM p)
SELECT dataset, feature, round(d, 6) AS ks, p, round(-log10(greatest(p, 1e-10)), 4) AS strength FROM o""",
        "shift_rank": f"""
WITH m AS ({moved}), {_ks(f"SELECT feature, {scaled} AS value, ref FROM m", "feature")}
SELECT feature, round(d, 6) AS ks, row_number() OVER (ORDER BY round(d, 6) DESC, feature) AS rank FROM k""",
        "missing_rate_report": f'WITH {doc} SELECT "column", n - p AS missing, round(100 * round((n - p) / CAST(n AS DOUBLE), 6), 2) AS pct FROM c',
        "limitations": f"""
WITH {doc}
SELECT 'no_sensitive' AS limitation, 1 AS n FROM v_doc LIMIT 1""".replace("LIMIT 1", "WHERE doc_id = (SELECT min(doc_id) FROM v_doc)")
        + " UNION ALL SELECT 'missing_values', sum(n - p) FROM c HAVING sum(n - p) > 0 UNION ALL SELECT 'unconfirmed_columns', count(*) FROM c WHERE \"column\" NOT IN ('lang', 'doc_id')",
        "reference_quantiles": f"WITH {_QUANTILES} SELECT * FROM q",
        "join_history_reference": f"""
WITH {_QUANTILES}, w AS (SELECT CASE dataset WHEN 'R' THEN 'F2' WHEN 'A' THEN 'N3' ELSE 'T1' END AS metric, round(max(gap), 6) AS value FROM v_exp GROUP BY 1)
SELECT metric, value, value > p75 AS above_p75,
  round(CASE WHEN value <= "min" THEN 0 WHEN value <= p25 THEN 25 * (value - "min") / (p25 - "min") WHEN value <= median THEN 25 + 25 * (value - p25) / (median - p25)
    WHEN value <= p75 THEN 50 + 25 * (value - median) / (p75 - median) WHEN value <= "max" THEN 75 + 25 * (value - p75) / ("max" - p75) ELSE 100 END, 4) AS percentile
FROM w JOIN q USING (metric)""",
    }
