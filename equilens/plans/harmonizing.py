"""Queries that bring raw tables to one schema, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.functions import scalars
from equilens.operators import harmonize as H
from equilens.sources.tables import view

Query = Callable[[SparkSession, str], DataFrame]
PAIN = {"ATA": 1.0, "NAP": 2.0, "ASY": 3.0}
CANCERS = ["melanoma", "basal cell"]
CODES = ["trestbps", "cp"]


def _image(df: DataFrame) -> DataFrame:
    return H.pad_standardize(df, "diagnostic", "age", "gender", "fitspatrick")


def _image_columns(df: DataFrame) -> DataFrame:
    return df.select("row_id", "diagnostic_label", "skin_cancer", "age_raw", "age_group", "sex_label", "sex", "fitzpatrick", "fitzpatrick_group")


def _presence(part: int) -> Query:
    return lambda s, d: H.image_presence_filter(view(s, d, "v_image").select("row_id", "img_id"), "img_id", view(s, d, "v_listing"))[part]


def _scin(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, labels = view(spark, sf_dir, "v_cases"), view(spark, sf_dir, "v_case_labels")
    found = H.scin_standardize(cases, labels, "case_id", "weights", "age_group", "sex_at_birth", "skin_type", "race", CANCERS)
    return found.select("case_id", "diagnostic_label", "skin_cancer", "age_group", "sex_label", "sex", "fitzpatrick", "fitzpatrick_group", "race_group")


def _scalars(df: DataFrame) -> DataFrame:
    c = F.col
    return df.select(
        "case_id",
        scalars.age_token(c("age_group")).alias("age"),
        scalars.fst_numeric(c("skin_type")).alias("skin"),
        scalars.skin_group(scalars.fst_numeric(c("skin_type"))).alias("skin_group"),
        scalars.bmi(c("case_id") % 60 + 50.0, F.lit(175.0)).alias("bmi"),
        scalars.display_label(c("race"), {"WHITE": "White", "ASIAN, WHITE": "Several"}).alias("shown"),
        scalars.display_rank(c("race"), ["WHITE", "ASIAN, WHITE"]).alias("shown_rank"),
        scalars.percentile_position(c("case_id").cast("double"), [0.0, 100.0, 400.0, 800.0, 1500.0]).alias("position"),
        F.element_at(scalars.minmax_scale(F.array(F.lit(0.0), c("case_id").cast("double"), F.lit(5000.0))), 2).alias("scaled"),
        F.to_json(F.struct("case_id", "race")).alias("json"),
    )


def queries() -> dict[str, Query]:
    def on(name: str, op: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: op(view(spark, sf_dir, name))

    clinic, image, cases = (lambda op, n=n: on(n, op) for n in ("v_clinic", "v_image", "v_cases"))
    views = ["row_id", "sex", "age_group", "fitzpatrick_group", *H.GROUP_VIEWS]
    return {
        "harmonize_schema": clinic(lambda d: H.harmonize_schema(d, ["Age_years", "age"], "sex", ["diagnosis"]).select("row_id", "age_raw", "sex_label", "sex_bin", "target")),
        "standardize_sensitive": clinic(
            lambda d: H.standardize_sensitive(d.withColumn("years", F.col("age").try_cast("double")), "years", "gender").select("row_id", "age_group", "sex_label", "sex_bin")
        ),
        "standardize_target": clinic(lambda d: H.standardize_target(d, "diagnosis", {"yes": "disease", "no": "no_disease"}).select("row_id", "target")),
        "coalesce_aliases": clinic(lambda d: H.coalesce_aliases(d.select("row_id", "chol", "cholesterol"), {"chol": ["serum", "cholesterol"]})),
        "value_map_encode": clinic(lambda d: H.value_map_encode(d, "pain", PAIN).select("row_id", "pain")),
        "value_map_unmapped": clinic(lambda d: H.unmapped_values(d, "pain", PAIN)),
        "include_exclude_columns": clinic(lambda d: H.include_exclude_columns(d, ["cp", "thal", "site"], ["thal"], ["row_id"])),
        "pad_standardize": image(lambda d: _image_columns(_image(d))),
        "image_presence_filter": _presence(0),
        "image_presence_report": lambda s, d: _presence(1)(s, d).withColumn("first_missing", F.array_join("first_missing", " ")),
        "first_resolvable_path": lambda s, d: H.first_resolvable_path(view(s, d, "v_cases"), "case_id", ["image_1", "image_2", "image_3"], view(s, d, "v_listing")),
        "scin_standardize": _scin,
        "age_unit_normalize": clinic(lambda d: H.age_unit_normalize(d.select("row_id", (F.col("row_id") * 37).alias("days")), "days")),
        "missing_policy": clinic(lambda d: H.missing_policy(d.select("row_id", "chol", "gender"), "drop_rows")),
        "missing_policy_image": image(
            lambda d: H.missing_policy_image(d.select("row_id", "img_id", "gender", "age", F.col("fitspatrick").cast("double").alias("skin")), ["row_id", "img_id"], ["gender"])
        ),
        "decode_sensitive": clinic(
            lambda d: H.decode_sensitive(H.decode_sensitive(d, "cp", ["a", "b", "c", "d", "e"], "cp_label"), "site", ["1", "2", "3", "4", "5"], "site_label").select("row_id", "cp_label", "site_label")
        ),
        "decode_groups": clinic(lambda d: d.select("row_id", H.decode_groups(F.col("sex"), {0: "Female", 1: "Male"}).alias("grp"))),
        "derive_group_views": image(lambda d: H.derive_group_views(_image(d)).select(*views)),
        "is_unknown_label": image(lambda d: H.derive_group_views(_image(d)).select("row_id", H.is_unknown_label(F.col("age_x_skin")).alias("unknown"))),
        "resolve_cluster_features": clinic(lambda d: H.resolve_cluster_features(d, "trestbps", "row_id", ["cp"])),
        "feature_set_mode": clinic(
            lambda d: d.agg(*(F.count(c).alias(c) for c in H.feature_set([*d.columns, "sex"], ["sex", "site"], "include_site_only") if c not in ("age", "gender")))
        ),
        "cohort_recode": clinic(lambda d: H.cohort_recode(d, ["cp"], "thal", ["trestbps"]).select("row_id", "cp", "thal", "trestbps")),
        "canonical_key": clinic(lambda d: H.canonical_key(d, ["row_id", "oldpeak", "chol"], ["oldpeak"])),
        "sex_label_resolve": clinic(lambda d: H.sex_label_resolve(d, ["sex_extended", "sex", "gender"]).select("row_id", "sex_resolved")),
        "case_scalars": cases(_scalars),
        "str_top_weighted_key": on("v_case_labels", lambda d: d.select("case_id", scalars.top_weighted_key(F.col("weights")).alias("top"))),
    }


_CODE = "CASE WHEN {0} IN ('0', 'F', 'Female') THEN 'Female' WHEN {0} IN ('1', '2', 'M', 'Male') THEN 'Male' END"
_BIN = "CASE sex_label WHEN 'Female' THEN 0 WHEN 'Male' THEN 1 END AS sex_bin"
_YEARS = "TRY_CAST(age AS DOUBLE)"
_IMAGE_AGE = f"""
CASE WHEN {_YEARS} >= 0 AND {_YEARS} <= 20 THEN '<20' WHEN {_YEARS} > 20 AND {_YEARS} <= 40 THEN '20-39' WHEN {_YEARS} > 40 AND {_YEARS} <= 60 THEN '40-59'
 WHEN {_YEARS} > 60 AND {_YEARS} <= 80 THEN '60-79' WHEN {_YEARS} > 80 AND {_YEARS} <= 120 THEN '80+' ELSE 'unknown' END AS age_group"""
_IMAGE = f"""
i AS (
  SELECT row_id, upper(trim(diagnostic)) AS diagnostic_label,
    CASE WHEN upper(trim(diagnostic)) IN ('BCC', 'SCC', 'MEL') THEN 1 WHEN upper(trim(diagnostic)) IN ('ACK', 'NEV', 'SEK') THEN 0 END AS skin_cancer,
    {_YEARS} AS age_raw, {_IMAGE_AGE},
    CASE upper(trim(gender)) WHEN 'FEMALE' THEN 'Female' WHEN 'MALE' THEN 'Male' ELSE 'unknown' END AS sex_label,
    CASE upper(trim(gender)) WHEN 'FEMALE' THEN 0 WHEN 'MALE' THEN 1 ELSE -1 END AS sex,
    coalesce(fitspatrick, 'unknown') AS fitzpatrick,
    CASE WHEN fitspatrick IN ('1', '2') THEN 'I-II' WHEN fitspatrick IN ('3', '4') THEN 'III-IV' WHEN fitspatrick IS NULL THEN 'unknown' ELSE 'V-VI' END AS fitzpatrick_group
  FROM v_image)"""
_VIEWS = """
g AS (
  SELECT row_id, sex, age_group, fitzpatrick_group, fitzpatrick_group AS skin_view,
    CASE WHEN age_group = 'unknown' THEN 'Unknown' WHEN age_group IN ('<20', '20-39') THEN '<40' WHEN age_group = '40-59' THEN '40-59' ELSE '60+' END AS age_coarse,
    CASE sex WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE 'Unknown' END AS sex_view
  FROM i WHERE skin_cancer IS NOT NULL)"""
_TOP = """
w AS (
  SELECT case_id, regexp_extract_all(weights, '[''"]([^''"]+)[''"]\\s*:\\s*([0-9.eE+-]+)', 1) AS k,
    [CAST(x AS DOUBLE) FOR x IN regexp_extract_all(weights, '[''"]([^''"]+)[''"]\\s*:\\s*([0-9.eE+-]+)', 2)] AS v
  FROM v_case_labels),
t AS (SELECT case_id, k[list_position(v, list_max(v))] AS top FROM w)"""


def oracle_sql() -> dict[str, str]:
    return {
        "harmonize_schema": f"""
SELECT row_id, CASE WHEN {_YEARS} IS NOT NULL THEN least(120, greatest(0, {_YEARS})) END AS age_raw, sex_label, {_BIN}, TRY_CAST(diagnosis AS DOUBLE) AS target
FROM (SELECT *, {_CODE.format("CAST(sex AS VARCHAR)")} AS sex_label FROM v_clinic) q""",
        "standardize_sensitive": f"""
SELECT row_id, sex_label, {_BIN},
  CASE WHEN y >= 0 AND y <= 40 THEN '<40' WHEN y > 40 AND y <= 50 THEN '40-49' WHEN y > 50 AND y <= 60 THEN '50-59'
    WHEN y > 60 AND y <= 70 THEN '60-69' WHEN y > 70 AND y <= 120 THEN '70+' END AS age_group
FROM (SELECT *, {_CODE.format("trim(gender)")} AS sex_label, {_YEARS} AS y FROM v_clinic) q""",
        "standardize_target": "SELECT row_id, CASE diagnosis WHEN 'yes' THEN 1.0::DOUBLE WHEN 'no' THEN 0.0::DOUBLE END AS target FROM v_clinic",
        "coalesce_aliases": "SELECT row_id, coalesce(chol, cholesterol) AS chol FROM v_clinic",
        "value_map_encode": "SELECT row_id, CASE trim(pain) WHEN 'ATA' THEN 1.0::DOUBLE WHEN 'NAP' THEN 2.0::DOUBLE WHEN 'ASY' THEN 3.0::DOUBLE END AS pain FROM v_clinic",
        "value_map_unmapped": "SELECT trim(pain) AS value, count(*) AS n FROM v_clinic WHERE trim(pain) NOT IN ('ATA', 'NAP', 'ASY') GROUP BY 1",
        "include_exclude_columns": "SELECT row_id, cp, site FROM v_clinic",
        "pad_standardize": f"WITH {_IMAGE} SELECT * FROM i WHERE skin_cancer IS NOT NULL",
        "image_presence_filter": "SELECT row_id, img_id, path AS image_path FROM v_image JOIN v_listing ON img_id = name",
        "image_presence_report": """
WITH m AS (SELECT img_id, path FROM v_image LEFT JOIN v_listing ON img_id = name)
SELECT count(path) AS found, count(*) - count(path) AS missing, (SELECT string_agg(img_id, ' ' ORDER BY img_id) FROM (SELECT img_id FROM m WHERE path IS NULL ORDER BY 1 LIMIT 50) f) AS first_missing
FROM m""",
        "first_resolvable_path": """
SELECT case_id, coalesce(a.path, b.path, c.path) AS image_path
FROM v_cases LEFT JOIN v_listing a ON a.name = split_part(image_1, '/', 2) LEFT JOIN v_listing b ON b.name = split_part(image_2, '/', 2)
  LEFT JOIN v_listing c ON c.name = split_part(image_3, '/', 2)
WHERE coalesce(a.path, b.path, c.path) IS NOT NULL""",
        "scin_standardize": f"""
WITH {_TOP}
SELECT case_id, top AS diagnostic_label, CASE WHEN lower(top) LIKE '%melanoma%' OR lower(top) LIKE '%basal cell%' THEN 1 ELSE 0 END AS skin_cancer,
  replace(substr(lower(age_group), 5), '_to_', '-') AS age_group,
  CASE sex_at_birth WHEN 'FEMALE' THEN 'Female' WHEN 'MALE' THEN 'Male' ELSE 'unknown' END AS sex_label,
  CASE sex_at_birth WHEN 'FEMALE' THEN 0 WHEN 'MALE' THEN 1 ELSE -1 END AS sex, substr(skin_type, 4) AS fitzpatrick,
  CASE WHEN substr(skin_type, 4) IN ('1', '2') THEN 'I-II' WHEN substr(skin_type, 4) IN ('3', '4') THEN 'III-IV' ELSE 'V-VI' END AS fitzpatrick_group,
  CASE race WHEN 'WHITE' THEN 'White' WHEN 'ASIAN, WHITE' THEN 'Multiple' WHEN 'BLACK_OR_AFRICAN' THEN 'Black Or African' ELSE 'unknown' END AS race_group
FROM t JOIN v_cases USING (case_id) WHERE top IS NOT NULL""",
        "age_unit_normalize": "SELECT row_id, round_even(row_id * 37 / 365.25::DOUBLE, 2) AS days FROM v_clinic",
        "missing_policy": "SELECT row_id, chol, gender FROM v_clinic WHERE chol IS NOT NULL AND gender IS NOT NULL",
        "missing_policy_image": """
SELECT row_id, img_id, coalesce(gender, 'unknown') AS gender, coalesce(age, 'unknown') AS age,
  coalesce(CAST(fitspatrick AS DOUBLE), (SELECT quantile_cont(CAST(fitspatrick AS DOUBLE), 0.5) FROM v_image)) AS skin
FROM v_image""",
        "decode_sensitive": """
SELECT row_id, substr('abcde', CAST(cp AS INTEGER), 1) AS cp_label,
  CASE WHEN site <= lo + (hi - lo) * 1 / 5.0 THEN '1' WHEN site <= lo + (hi - lo) * 2 / 5.0 THEN '2' WHEN site <= lo + (hi - lo) * 3 / 5.0 THEN '3'
    WHEN site <= lo + (hi - lo) * 4 / 5.0 THEN '4' ELSE '5' END AS site_label
FROM v_clinic, (SELECT min(site) AS lo, max(site) AS hi FROM v_clinic) b""",
        "decode_groups": "SELECT row_id, CASE sex WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE CAST(sex AS VARCHAR) END AS grp FROM v_clinic",
        "derive_group_views": f"WITH {_IMAGE}, {_VIEWS} SELECT *, sex_view || ' x ' || skin_view AS sex_x_skin, age_coarse || ' x ' || skin_view AS age_x_skin FROM g",
        "is_unknown_label": f"WITH {_IMAGE}, {_VIEWS} SELECT row_id, age_coarse = 'Unknown' OR skin_view = 'unknown' AS unknown FROM g",
        "resolve_cluster_features": """
SELECT * FROM (VALUES ('row_id', 'index'), ('age', 'non_numeric'), ('sex', NULL), ('gender', 'non_numeric'), ('diagnosis', 'non_numeric'), ('chol', NULL), ('cholesterol', NULL),
  ('pain', 'non_numeric'), ('cp', 'engine_output'), ('thal', NULL), ('trestbps', 'target'), ('oldpeak', NULL), ('site', NULL), ('segment', 'non_numeric')) v("column", reason)
WHERE EXISTS (SELECT 1 FROM v_clinic)""",
        "feature_set_mode": "SELECT " + ", ".join(f"count({c}) AS {c}" for c in ("row_id", "diagnosis", "chol", "cholesterol", "pain", "cp", "thal", "trestbps", "oldpeak", "site", "segment")) + " FROM v_clinic",
        "cohort_recode": "SELECT row_id, cp - 1 AS cp, CASE thal WHEN 3 THEN 0 WHEN 6 THEN 1 WHEN 7 THEN 2 END AS thal, nullif(trestbps, 0) AS trestbps FROM v_clinic",
        "canonical_key": "SELECT row_id, round_even(oldpeak, 1) AS oldpeak, CAST(chol AS BIGINT) AS chol FROM v_clinic",
        "sex_label_resolve": f"SELECT row_id, coalesce({_CODE.format('CAST(sex AS VARCHAR)')}, {_CODE.format('trim(gender)')}) AS sex_resolved FROM v_clinic",
        "case_scalars": """
SELECT case_id, replace(substr(lower(age_group), 5), '_to_', '-') AS age, CAST(substr(skin_type, 4) AS DOUBLE) AS skin,
  CASE WHEN substr(skin_type, 4) IN ('1', '2') THEN 'I-II' WHEN substr(skin_type, 4) IN ('3', '4') THEN 'III-IV' ELSE 'V-VI' END AS skin_group,
  round((case_id % 60 + 50.0::DOUBLE) / (1.75::DOUBLE * 1.75::DOUBLE), 6) AS bmi,
  CASE race WHEN 'WHITE' THEN 'White' WHEN 'ASIAN, WHITE' THEN 'Several' ELSE race END AS shown,
  CASE race WHEN 'WHITE' THEN 0 WHEN 'ASIAN, WHITE' THEN 1 ELSE 2 END AS shown_rank,
  round(CASE WHEN case_id <= 100 THEN 25.0 * case_id / 100.0 WHEN case_id <= 400 THEN 25 + 25.0 * (case_id - 100) / 300.0
    WHEN case_id <= 800 THEN 50 + 25.0 * (case_id - 400) / 400.0 WHEN case_id <= 1500 THEN 75 + 25.0 * (case_id - 800) / 700.0 ELSE 100 END::DOUBLE, 6) AS position,
  CASE WHEN case_id > 5000 THEN 1.0 ELSE case_id / 5000.0 END::DOUBLE AS scaled,
  '{"case_id":' || CAST(case_id AS VARCHAR) || CASE WHEN race IS NULL THEN '' ELSE ',"race":"' || race || '"' END || '}' AS json
FROM v_cases""",
        "str_top_weighted_key": f"WITH {_TOP} SELECT * FROM t",
    }
