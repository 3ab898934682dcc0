"""Group fairness and performance of predictions, as tidy tables.

Every operator unpivots the sensitive attributes and groups once, so that any
number of attributes costs one pass and one shuffle of partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equilens.operators.harmonize import is_unknown_label
from equilens.operators.statistics import running

FAIR = 0.1


def by_attribute(df: DataFrame, attrs: list[str], keep: list[str]) -> DataFrame:
    """A row for each row and attribute: attr, grp; rows with a null attribute have no group."""
    pairs = F.array(*(F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("grp")) for a in attrs))
    return df.select(*keep, F.inline(pairs)).where("grp IS NOT NULL")


def ratio(a: Column, b: Column, none=0.0) -> Column:
    """a / b, and `none` for 0 / 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(none).cast("double"))


def group_counts(df: DataFrame, attrs: list[str], extra: list[str] = ()) -> DataFrame:
    """n, tp, fp, tn, fn for each attribute and group (and the columns `extra`)."""
    rows = by_attribute(df, attrs, ["y_true", "y_pred", *extra])
    hit = lambda t, p: F.sum(F.when((F.col("y_true") == t) & (F.col("y_pred") == p), 1).otherwise(0))
    return rows.groupBy(*extra, "attr", "grp").agg(F.count("*").alias("n"), hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fn"))


def rates(counts: DataFrame) -> DataFrame:
    c = F.col
    return counts.withColumns(
        {
            "positive_rate": ratio(c("tp") + c("fp"), c("n")),
            "tpr": ratio(c("tp"), c("tp") + c("fn")),
            "fpr": ratio(c("fp"), c("fp") + c("tn")),
            "fnr": ratio(c("fn"), c("tp") + c("fn")),
            "precision": ratio(c("tp"), c("tp") + c("fp")),
        }
    )


METRICS = {"demographic_parity": ["positive_rate"], "equalized_odds": ["tpr", "fpr", "fnr"], "equal_opportunity": ["tpr"], "predictive_parity": ["precision"]}


def fairness_metrics(df: DataFrame, attrs: list[str], metrics: list[str], extra: list[str] = ()) -> DataFrame:
    """(attr, metric, grp, value, n, max_difference, is_fair): a group's value, and the gap of its metric over the groups."""
    names = [m for k in metrics for m in METRICS[k]]
    names = list(dict.fromkeys(names))
    table = rates(group_counts(df, attrs, extra))
    long = table.select(*extra, "attr", "grp", "n", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names))))
    w = Window.partitionBy(*extra, "attr", "metric")
    gap = F.max("value").over(w) - F.min("value").over(w)
    return long.select(*extra, "attr", "metric", "grp", F.round("value", 6).alias("value"), "n", F.round(gap, 6).alias("max_difference"), (F.round(gap, 9) < FAIR).alias("is_fair"))


def calibration_by_group(df: DataFrame, attrs: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error of each group over equal-width bins, and the largest gap of an attribute."""
    rows = by_attribute(df, attrs, ["y_true", "y_proba"])
    binned = rows.withColumn("bin", F.least(F.floor(F.round(F.col("y_proba") * bins, 9)), F.lit(bins - 1)))
    per_bin = binned.groupBy("attr", "grp", "bin").agg(F.count("*").alias("m"), F.avg("y_proba").alias("p"), F.avg("y_true").alias("y"))
    ece = per_bin.groupBy("attr", "grp").agg((F.sum(F.col("m") * F.abs(F.col("p") - F.col("y"))) / F.sum("m")).alias("ece"), F.sum("m").alias("n"))
    w = Window.partitionBy("attr")
    return ece.select("attr", "grp", F.round("ece", 6).alias("ece"), "n", F.round(F.max("ece").over(w) - F.min("ece").over(w), 6).alias("max_difference"))


def roc_auc(df: DataFrame, keys: list[str]) -> DataFrame:
    """Exact AUC by mid-ranks over distinct scores, ties halved; null for a single class."""
    scores = df.groupBy(*keys, "y_proba").agg(F.sum("y_true").alias("pos"), F.sum(1 - F.col("y_true")).alias("neg"))
    upto = running(scores, keys, "y_proba", {"neg": "_neg"})
    sums = upto.withColumn("won", F.col("pos") * (F.col("_neg") - F.col("neg") / 2)).groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return sums.select(*keys, F.round(F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("won") / (F.col("pos") * F.col("neg"))), 6).alias("auc"))


def group_performance(df: DataFrame, attrs: list[str], extra: list[str] = ()) -> DataFrame:
    """accuracy, precision, recall, f1, prevalence and AUC of each group; null where undefined."""
    c = F.col
    table = group_counts(df, attrs, extra)
    null = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    perf = table.select(
        *extra, "attr", "grp", "n", null(c("tp") + c("tn"), c("n")).alias("accuracy"), null(c("tp"), c("tp") + c("fp")).alias("precision"), null(c("tp"), c("tp") + c("fn")).alias("recall"),
        null(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"), null(c("tp") + c("fn"), c("n")).alias("prevalence"),
    )
    keys = [*extra, "attr", "grp"]
    return perf.join(roc_auc(by_attribute(df, attrs, ["y_true", "y_proba", *extra]), keys), keys)


#: Rows that a group must have, and a group of an intersection.
LEAST_ROWS, LEAST_CELL_ROWS = 50, 30


def group_status(df: DataFrame, attrs: list[str], least: int | dict[str, int] = LEAST_ROWS, extra: list[str] = ()) -> DataFrame:
    """Counts and rates of each group with its status: undersized, degenerate, unknown or compared; the first that holds."""
    c = F.col
    need = F.lit(least) if isinstance(least, int) else F.create_map(*(F.lit(x) for pair in least.items() for x in pair))[c("attr")]
    one_class = (c("tp") + c("fn") == 0) | (c("fp") + c("tn") == 0)
    status = F.when(c("n") < need, "undersized").when(one_class, "degenerate").when(is_unknown_label(c("grp")), "unknown").otherwise("compared")
    return rates(group_counts(df, attrs, extra)).withColumn("status", status)


def gated_report(df: DataFrame, attrs: list[str], least: int | dict[str, int] = LEAST_ROWS, extra: list[str] = ()) -> DataFrame:
    """Rates of each group with a status; only compared groups count for the gaps, which are null for fewer than two."""
    w = Window.partitionBy(*extra, "attr")  # a row for each group
    used = F.col("status") == "compared"

    def gap(m: str) -> Column:
        value = F.when(used, F.col(m))
        return F.when(F.sum(used.cast("int")).over(w) >= 2, F.round(F.max(value).over(w) - F.min(value).over(w), 6))

    shown = [F.round(m, 6).alias(m) for m in ("positive_rate", "tpr", "fpr")]
    gaps = [gap(m).alias(n) for n, m in (("dp_gap", "positive_rate"), ("tpr_gap", "tpr"), ("fpr_gap", "fpr"))]
    return group_status(df, attrs, least, extra).select(*extra, "attr", "grp", "n", "status", *shown, *gaps)


def confusion_metrics(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    hit = lambda t, p: F.sum(F.when((F.col("y_true") == t) & (F.col("y_pred") == p), 1).otherwise(0))
    t = df.groupBy(*keys).agg(F.count("*").alias("n"), hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fn"))
    c = F.col
    return t.select(*keys, "n", "tp", "fp", "tn", "fn", F.round(ratio(c("tp") + c("tn"), c("n")), 6).alias("accuracy"), F.round(ratio(c("tp"), c("tp") + c("fp")), 6).alias("precision"), F.round(ratio(c("tp"), c("tp") + c("fn")), 6).alias("recall"), F.round(ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")), 6).alias("f1"))


def threshold_sweep(df: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7)) -> DataFrame:
    """Confusion metrics at each threshold, in one pass."""
    rows = df.select("y_true", "y_proba", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return confusion_metrics(rows.withColumn("y_pred", (F.col("y_proba") >= F.col("threshold")).cast("int")), ["threshold"])


def prediction_table(df: DataFrame, threshold: float = 0.5, margin: float = 0.1) -> DataFrame:
    p = F.col("y_proba")
    return df.withColumns({"y_pred": (p >= threshold).cast("int"), "threshold": F.lit(threshold), "confidence": F.round(F.abs(p - 0.5), 6), "near_threshold": F.round(F.abs(p - threshold), 9) < margin})


def outcome_class(df: DataFrame) -> DataFrame:
    t, p = F.col("y_true"), F.col("y_pred")
    return df.withColumn("outcome", F.when((t == 1) & (p == 1), "TP").when((t == 0) & (p == 1), "FP").when((t == 0) & (p == 0), "TN").when((t == 1) & (p == 0), "FN"))
