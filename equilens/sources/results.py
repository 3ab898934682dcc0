"""Experiment results and run histories as JSON, and the partitioned outputs of the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One result file: what identifies the run, its hold-out metrics, and the cross-validated means, which win.
RESULT = "experiment_id string, dataset string, configuration map<string,string>, test_metrics map<string,double>, cv_results map<string,struct<mean:double,std:double>>, fairness_metrics map<string,map<string,double>>, status string"


def read_experiment_results(spark: SparkSession, path: str, metrics: list[str]) -> DataFrame:
    """One row a result file below `path`: identity, `<metric>_value` for each of `metrics`, and the fairness metrics.

    A metric is the cross-validated mean, else the hold-out value, else null. Files that are no JSON object, or lack an
    experiment_id, are left out.
    """
    raw = spark.read.schema(RESULT).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path, multiLine=True)
    values = [F.coalesce(F.col("cv_results")[m]["mean"], F.col("test_metrics")[m]).alias(f"{m}_value") for m in metrics]
    return raw.where("experiment_id IS NOT NULL").select("experiment_id", "dataset", "configuration", "status", *values, "fairness_metrics")


def fairness_gaps(results: DataFrame) -> DataFrame:
    """(experiment_id, dataset, attr, metric, gap) of `read_experiment_results`."""
    attrs = results.select("experiment_id", "dataset", F.explode("fairness_metrics").alias("attr", "_m"))
    return attrs.select("experiment_id", "dataset", "attr", F.explode("_m").alias("metric", "gap"))


def write_partitioned(df: DataFrame, path: str, keys: list[str], mode: str = "overwrite") -> None:
    """Splits, predictions or standardised tables as Parquet by `keys`.

    Rows meet by the keys and a random salt, so that few large files are written and a hot key is not one task's.
    """
    salted = df.repartition(*keys, F.pmod(F.xxhash64(*df.columns), F.lit(8)))
    salted.write.mode(mode).partitionBy(*keys).parquet(path)


def append_run_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def scan_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All records that runs have appended below `path`."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path)


def profile_json(df: DataFrame, section: str) -> DataFrame:
    """(section, json): each row of a tidy profile or report as one JSON object."""
    return df.select(F.lit(section).alias("section"), F.to_json(F.struct(*df.columns)).alias("json"))


def prediction_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Predictions from `<dataset>_<model>_<train|test>.csv` below `root`, tagged; models that lack one of the two are left out."""
    name = F.regexp_extract("_metadata.file_name", r"^(.+)_(train|test)\.csv$", 1)
    part = F.regexp_extract("_metadata.file_name", r"^(.+)_(train|test)\.csv$", 2)
    rows = spark.read.csv(root, header=True, inferSchema=True, pathGlobFilter="*.csv").withColumns({"run": name, "part": part}).where("part <> ''")
    whole = rows.groupBy("run").agg(F.count_distinct("part").alias("_n")).where("_n = 2").select("run")
    return rows.join(F.broadcast(whole), "run", "left_semi")  # one row for each model


def image_listing(spark: SparkSession, root: str, glob: str = "*.{jpg,jpeg,png}") -> tuple[DataFrame, DataFrame]:
    """(name, path), the last path of a name, and (name, copies) of names that occur more than once. No file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path")
    grouped = files.groupBy("name").agg(F.max("path").alias("path"), F.count("*").alias("copies"))
    return grouped.select("name", "path"), grouped.where("copies > 1").select("name", "copies")
