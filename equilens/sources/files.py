"""Files of datasets, studies and mitigations, and the tables that a comparison writes."""

from __future__ import annotations

import csv
import logging
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.sources.results import write_partitioned

log = logging.getLogger(__name__)
#: Lines from which separator and header are told.
SAMPLE_LINES = 50


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def sniffed(lines: list[str]) -> tuple[str, bool]:
    """(separator, has a header) of the first lines of a file: comma, semicolon, tab or bar; a header has words where the next lines have numbers."""
    try:
        separator = csv.Sniffer().sniff("\n".join(lines), delimiters=",;\t|").delimiter
    except csv.Error:
        separator = ","
    rows = list(csv.reader(lines, delimiter=separator))
    if len(rows) < 2:
        return separator, bool(rows) and sum(map(_is_number, rows[0])) < len(rows[0]) / 2
    numeric = [all(_is_number(r[i]) for r in rows[1:] if len(r) > i and r[i].strip()) for i in range(len(rows[0]))]
    if any(numeric):
        return separator, not any(_is_number(c) for c, n in zip(rows[0], numeric) if n)
    return separator, len(set(rows[0])) == len(rows[0]) and not any(rows[0][i] in {r[i] for r in rows[1:] if len(r) > i} for i in range(len(rows[0])))


def read_csv_sniffed(spark: SparkSession, path: str) -> DataFrame:
    """CSV of unknown separator and header; without a header the columns are _c0, _c1 and so on."""
    lines = [r[0] for r in spark.read.text(path).limit(SAMPLE_LINES).collect()]
    separator, header = sniffed(lines)
    return spark.read.csv(path, sep=separator, header=header, inferSchema=True)


def read_two_files(spark: SparkSession, cases: str, labels: str, key: str, kept: list[str]) -> DataFrame:
    """Cases with the columns `kept` of their labels; cases without labels go."""
    read = lambda p: spark.read.csv(p, header=True, inferSchema=True)
    return read(cases).join(read(labels).select(key, *kept), key)


def load_datasets(readers: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """All datasets that can be read, tagged, in one table, and the errors of those that can't."""
    out, failed = None, {}
    for name, read in readers.items():
        try:
            own = read().withColumn("dataset", F.lit(name))
        except PySparkException as e:
            failed[name] = str(e).splitlines()[0]
            log.warning("dataset %s is skipped: %s", name, failed[name])
            continue
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out, failed


def read_mitigation_index(spark: SparkSession, index: str, root: str) -> DataFrame:
    """Predictions of mitigated models below `root`, with the model, technique and constraint that the index gives their file.

    The index is JSON with one object for each file: file, model, technique, constraint. Files that it lacks are left out.
    """
    listed = spark.read.schema("file string, model string, technique string, constraint string").json(index, multiLine=True)
    rows = spark.read.csv(root, header=True, inferSchema=True, recursiveFileLookup=True, pathGlobFilter="*.csv").withColumn("file", F.col("_metadata.file_name"))
    return rows.join(F.broadcast(listed.where("file IS NOT NULL")), "file")  # a row for each file


#: A study's manifest, and the training results of one of its runs.
MANIFEST = "study_id string, runs array<struct<sub_key:string,mode:string,model:string,status:string>>"
TRAINED = "sub_key string, dataset string, model string, f1 double, recall double, accuracy double, auc double"


def read_study_results(spark: SparkSession, manifests: str, results: str) -> DataFrame:
    """(study_id, mode, model, dataset, f1, recall, accuracy, auc): the results of the successful runs of all studies."""
    runs = spark.read.schema(MANIFEST).json(manifests, multiLine=True).select("study_id", F.inline("runs"))
    ok = runs.where((F.lower(F.trim("status")) == "success") & (F.trim("mode") != "")).select("study_id", "sub_key", "mode", F.lower(F.trim("model")).alias("model"))
    trained = spark.read.schema(TRAINED).option("recursiveFileLookup", True).json(results).withColumn("model", F.lower(F.trim("model")))
    return ok.join(trained, ["sub_key", "model"]).select("study_id", "mode", "model", "dataset", "f1", "recall", "accuracy", "auc")


def write_standardized(df: DataFrame, path: str) -> None:
    """Standardised tables by dataset."""
    write_partitioned(df, path, ["dataset"])


def write_splits(df: DataFrame, path: str) -> None:
    """Training and test rows, plain or scaled, by dataset, binning and split."""
    write_partitioned(df, path, ["dataset", "binning", "split"])


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions by dataset and method of splitting."""
    write_partitioned(df, path, ["dataset", "split_method"])


def write_comparison_tables(tables: dict[str, DataFrame], path: str, run_id: str) -> DataFrame:
    """Writes each table below `path`, and a manifest of their row counts, which it returns; rows are counted from the footers of what is written."""
    spark, counts = next(iter(tables.values())).sparkSession, {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        counts[name] = spark.read.schema(df.schema).parquet(f"{path}/{name}").count()
    manifest = spark.createDataFrame([(run_id, n, c) for n, c in counts.items()], "run_id string, table string, rows long")  # a row for each table
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest
