"""Tables of the audits: predictions, experiments and lineage, as views over the given tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.operators.graph import shared_folder

_GROUPED = """
SELECT l_returnflag || '/' || l_linestatus || '/' || CAST(l_linenumber % 3 AS STRING) || '/' || CAST(l_suppkey % 4 AS STRING) || '/' || CAST(l_partkey % 2 AS STRING) AS experiment_id,
  l_returnflag AS dataset, l_linestatus AS model_type, CAST(l_linenumber % 3 AS STRING) AS binning, CAST(l_partkey % 2 AS STRING) AS variant,
  CASE WHEN l_suppkey % 4 = 0 THEN 'baseline' ELSE 'm' || CAST(l_suppkey % 4 AS STRING) END AS mitigation,
  'shift_cat' AS attr, CAST(l_orderkey % 4 AS STRING) AS grp, '{metric}' AS metric, round(avg({value}) {scale}, 4) AS value, count(*) AS n
FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6, 8"""
_METRICS = (("tpr", "l_discount", "* 10"), ("fpr", "l_tax", "* 10"), ("demographic_parity_rate", "l_quantity", "/ 50"))

#: The same SELECT runs in Spark and in the SQL twin of a query.
VIEWS = {
    "v_pred": "SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS row_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true, CAST(l_quantity AS DOUBLE) / 50.0 AS y_proba, CASE WHEN CAST(l_quantity AS DOUBLE) / 50.0 >= 0.5 THEN 1 ELSE 0 END AS y_pred, l_linestatus AS grp_a, CAST(l_linenumber AS STRING) AS grp_b FROM lineitem",
    "v_pred_gated": "SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y_true, CAST(o_totalprice AS DOUBLE) / 500000.0 AS y_proba, CASE WHEN CAST(o_totalprice AS DOUBLE) / 500000.0 >= 0.5 THEN 1 ELSE 0 END AS y_pred, c_mktsegment AS segment, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown' ELSE o_orderpriority END AS priority FROM orders JOIN customer ON o_custkey = c_custkey",
    "v_doc": "SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, CASE WHEN d.n_chars >= 500 THEN 1 ELSE 0 END AS y_pred FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "v_age": "SELECT o_orderkey AS row_id, CAST(c_acctbal AS DOUBLE) AS age_raw, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target, c_mktsegment AS sex FROM customer JOIN orders ON c_custkey = o_custkey",
    "v_knn": "SELECT o_orderkey AS row_id, CAST(o_totalprice AS DOUBLE) AS f1, CAST(c_acctbal AS DOUBLE) AS f2, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target, CASE WHEN o_totalprice >= 250000 THEN 1 ELSE 0 END AS y_pred, c_mktsegment AS segment FROM customer JOIN orders ON c_custkey = o_custkey",
    "v_exp": "SELECT l_returnflag || '/' || l_linestatus || '/' || CAST(l_linenumber % 3 AS STRING) || '/' || CAST(l_suppkey % 4 AS STRING) || '/' || CAST(l_partkey % 2 AS STRING) AS experiment_id, l_returnflag AS dataset, l_linestatus AS model_type, CAST(l_linenumber % 3 AS STRING) AS binning, CASE WHEN l_suppkey % 4 = 0 THEN 'baseline' ELSE 'm' || CAST(l_suppkey % 4 AS STRING) END AS mitigation, CAST(l_partkey % 2 AS STRING) AS variant, round(avg(CAST(l_quantity AS DOUBLE)) / 50, 4) AS f1, round(avg(CAST(l_discount AS DOUBLE)) * 10, 4) AS recall, round(avg(CAST(l_tax AS DOUBLE)) * 10, 4) AS gap, round(avg(CAST(l_quantity AS DOUBLE)) / 60, 4) AS accuracy, round(avg(CAST(l_discount AS DOUBLE)) * 12, 4) AS auc FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6",
    "v_lineage_a": "SELECT l_partkey % 100 AS k1, l_linenumber AS k2, nullif(l_suppkey % 5, 0) AS k3 FROM lineitem WHERE l_returnflag = 'R'",
    "v_lineage_b": "SELECT l_partkey % 100 AS k1, l_linenumber AS k2, nullif(l_suppkey % 5, 0) AS k3 FROM lineitem WHERE l_returnflag = 'A'",
    "v_clinic": """
SELECT c_custkey AS row_id,
  CASE WHEN c_custkey % 17 = 0 THEN 'n/a' ELSE CAST(CAST(floor(c_acctbal / 70) AS BIGINT) AS STRING) END AS age,
  CASE WHEN c_custkey % 11 > 0 THEN c_nationkey % 4 END AS sex,
  CASE c_custkey % 5 WHEN 0 THEN ' F' WHEN 1 THEN 'Male' WHEN 2 THEN 'M ' WHEN 3 THEN 'x' END AS gender,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'yes' WHEN 'MACHINERY' THEN 'no' WHEN 'FURNITURE' THEN '1' ELSE '0' END AS diagnosis,
  CASE WHEN c_custkey % 3 = 0 THEN c_nationkey * 10 END AS chol,
  CASE WHEN c_custkey % 2 = 0 THEN c_nationkey * 10 + 1 END AS cholesterol,
  CASE c_nationkey % 5 WHEN 0 THEN 'ATA' WHEN 1 THEN 'NAP ' WHEN 2 THEN 'ASY' WHEN 3 THEN 'TA' END AS pain,
  c_nationkey % 4 + 1 AS cp, CASE c_nationkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 2 THEN 7 END AS thal,
  c_nationkey % 3 AS trestbps, round(c_acctbal / 1000, 3) AS oldpeak, c_nationkey AS site, c_mktsegment AS segment
FROM customer""",
    "v_image": """
SELECT c_custkey AS row_id, CAST(c_nationkey AS STRING) AS patient_id, 'img' || CAST(c_custkey AS STRING) || '.png' AS img_id,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'bcc' WHEN 'MACHINERY' THEN ' NEV' WHEN 'FURNITURE' THEN 'MEL' WHEN 'AUTOMOBILE' THEN 'ack' ELSE 'other' END AS diagnostic,
  CASE WHEN c_custkey % 13 > 0 THEN CAST(CAST(floor(c_acctbal / 100) AS BIGINT) AS STRING) END AS age,
  CASE c_custkey % 4 WHEN 0 THEN 'FEMALE' WHEN 1 THEN ' male' WHEN 2 THEN 'none' END AS gender,
  CASE WHEN c_nationkey % 7 > 0 THEN CAST(c_nationkey % 7 AS STRING) END AS fitspatrick
FROM customer""",
    "v_listing": """
SELECT 'img' || CAST(c_custkey AS STRING) || '.png' AS name, '/images/' || c_mktsegment || '/img' || CAST(c_custkey AS STRING) || '.png' AS path
FROM customer WHERE c_custkey % 9 > 0""",
    "v_cases": """
SELECT c_custkey AS case_id, 'AGE_' || CAST(c_nationkey % 5 * 10 AS STRING) || '_TO_' || CAST(c_nationkey % 5 * 10 + 9 AS STRING) AS age_group,
  CASE c_custkey % 3 WHEN 0 THEN 'FEMALE' WHEN 1 THEN 'MALE' END AS sex_at_birth, 'FST' || CAST(c_nationkey % 6 + 1 AS STRING) AS skin_type,
  CASE c_nationkey % 4 WHEN 0 THEN 'BLACK_OR_AFRICAN' WHEN 1 THEN 'ASIAN, WHITE' WHEN 2 THEN 'WHITE' END AS race,
  CASE WHEN c_custkey % 2 = 0 THEN 'a/img' || CAST(c_custkey AS STRING) || '.png' END AS image_1,
  'b/img' || CAST(c_custkey + 1 AS STRING) || '.png' AS image_2, 'b/img' || CAST(c_custkey + 2 AS STRING) || '.png' AS image_3
FROM customer""",
    "v_case_labels": """
SELECT c_custkey AS case_id, CASE c_mktsegment WHEN 'BUILDING' THEN '{"Eczema": 0.3, "Melanoma": 0.7}' WHEN 'MACHINERY' THEN '{"Acne": 0.5, "Basal Cell": 0.5}'
  WHEN 'FURNITURE' THEN '{"Psoriasis": 1.0}' WHEN 'AUTOMOBILE' THEN '{"Basal Cell": 0.9}' ELSE '{}' END AS weights
FROM customer WHERE c_custkey % 10 > 0""",
    "v_group_values": "SELECT *, round(avg(value) OVER (PARTITION BY experiment_id, attr, metric), 6) AS overall FROM (" + " UNION ALL ".join(_GROUPED.format(metric=m, value=v, scale=s) for m, v, s in _METRICS) + ") g",
    "v_runs": """
SELECT l_returnflag AS dataset, l_linestatus AS model, CASE WHEN l_suppkey % 3 = 0 THEN 'test' ELSE 'train' END AS split, l_suppkey % 6 AS cluster,
  CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS y_true, l_quantity / 50.0 AS y_proba, CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END AS y_pred,
  CAST(l_linenumber AS STRING) AS line, CASE WHEN l_partkey % 5 = 0 THEN 'unknown' ELSE CAST(l_partkey % 5 AS STRING) END AS part, l_partkey % 97 AS small
FROM lineitem""",
    "v_group": "SELECT o_orderkey AS row_id, o_custkey AS patient, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target, o_totalprice AS price FROM orders",
    "v_drift": "SELECT event_type, CAST(value AS DOUBLE) AS value FROM events",
}


TABLES = ("lineitem", "orders", "customer", "documents", "labels", "events", "embeddings")


def view(spark: SparkSession, sf_dir: str, name: str, join: str | None = None) -> DataFrame:
    """A view's DataFrame over the tables that it names; nothing is registered in the session. `join` is a hint for all of them."""
    sql = VIEWS[name]
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
    named = {t: df.hint(join) for t, df in named.items()} if join else named
    plain = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(named)})\b", r"\1 {\2}", plain), **named)


def stored(spark: SparkSession, sf_dir: str, name: str, key: str = "row_id") -> DataFrame:
    """A view as a table in the folder that all executors share, dealt by its key.

    What reads it again and again, as fits do, joins nothing again; its tasks are even, whatever the files of the input;
    and no side of the join is sent to the driver.
    """
    df = view(spark, sf_dir, name, "merge")
    path = shared_folder(spark, name)
    df.repartition(key).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def twin(sql: str) -> str:
    """`sql` with the views that it names in front, for another SQL engine."""
    used = [f"{n} AS ({q.replace('AS STRING', 'AS VARCHAR')})" for n, q in VIEWS.items() if re.search(rf"\b{n}\b", sql)]
    head = ", ".join(used)
    return f"WITH {head}, {sql.strip()[4:].lstrip()}" if sql.strip()[:5].upper() == "WITH " else f"WITH {head} {sql}"


def read_csv_autosep(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; the separator is ; where the first line has more of them than commas."""
    first = spark.read.text(path).limit(1).collect()
    head = first[0][0] if first else ""
    return spark.read.csv(path, sep=";" if head.count(";") > head.count(",") else ",", header=True, inferSchema=True)


def read_csv_headerless(spark: SparkSession, path: str, schema: str, site: str) -> DataFrame:
    """Headerless CSV of a known schema, ? for missing, tagged with its site."""
    return spark.read.schema(schema).csv(path, nullValue="?").withColumn("source_site", F.lit(site))


def tag_provenance(df: DataFrame, dataset: str) -> DataFrame:
    return df.withColumns({"_dataset_source": F.lit(dataset), "_dataset_file": F.col("_metadata.file_name")})


def union_datasets(parts: dict[str, DataFrame]) -> DataFrame:
    """All datasets in one table, tagged; columns that one lacks are null."""
    out = None
    for name, df in parts.items():
        own = df.withColumn("dataset", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
