"""Triage: rules over profile tables that give recommendations with a priority, and what follows from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the rules.
SIZE_RATIO, PARITY, LEAST_GROUP, REBIN_RATIO, LEAST_SLICE, MOST_NULL = 3.0, 0.15, 50, 5.0, 30, 0.10


def _rows(df: DataFrame, rules: list[tuple[str, str, str, Column, Column]], subject: Column) -> DataFrame:
    """(category, priority, rule, subject, evidence) for each rule (category, priority, name, condition, evidence) that holds."""
    made = [F.when(c, F.struct(F.lit(k).alias("category"), F.lit(p).alias("priority"), F.lit(n).alias("rule"), subject.alias("subject"), F.round(e.cast("double"), 4).alias("evidence"))) for k, p, n, c, e in rules]
    return df.select(F.inline(F.array_compact(F.array(*made))))


def attribute_profile(df: DataFrame, attrs: list[str], target: str) -> DataFrame:
    """One row per attribute: groups, least and largest group, their ratio, gap of positive rates, share of nulls."""
    long = df.select(F.col(target).alias("_y"), F.inline(F.array(*(F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("grp")) for a in attrs))))
    g = long.groupBy("attr", "grp").agg(F.count("*").alias("n"), F.avg("_y").alias("rate"))
    known = F.col("grp").isNotNull()
    t = g.groupBy("attr").agg(F.count_if(known).alias("groups"), F.min(F.when(known, F.col("n"))).alias("least"), F.max(F.when(known, F.col("n"))).alias("most"), (F.max(F.when(known, F.col("rate"))) - F.min(F.when(known, F.col("rate")))).alias("gap"), (F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)) / F.sum("n")).alias("nulls"))
    return t.withColumn("ratio", F.col("most") / F.col("least"))


def rule_representation(profile: DataFrame) -> DataFrame:
    c = F.col
    rules = [("representation", "P1", "size_ratio", c("ratio") > SIZE_RATIO, c("ratio")), ("representation", "P1", "parity", F.round("gap", 9) > PARITY, c("gap")), ("representation", "P1", "small_group", c("least") < LEAST_GROUP, c("least")), ("representation", "P2", "rebin", (c("groups") > 2) & (c("ratio") > REBIN_RATIO), c("ratio"))]
    return _rows(profile, rules, c("attr"))


def rule_sensitive_adequacy(profile: DataFrame) -> DataFrame:
    c = F.col
    return _rows(profile, [("sensitive", "P0", "nulls", F.round("nulls", 9) > MOST_NULL, c("nulls")), ("sensitive", "P0", "one_group", c("groups") < 2, c("groups"))], c("attr"))


def slices(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.concat_ws("|", a, b).alias("slice")).agg(F.count("*").alias("n"))


def low_support_intersections(df: DataFrame, a: str, b: str, least: int = LEAST_SLICE) -> DataFrame:
    return slices(df, a, b).where(F.col("n") < least)


def rule_intersections(df: DataFrame, a: str, b: str) -> DataFrame:
    """One recommendation for a pair of attributes with slices below the minimum; its evidence is their number."""
    few = low_support_intersections(df, a, b).agg(F.count("*").alias("n"))
    return _rows(few, [("representation", "P1", "small_slices", F.col("n") > 0, F.col("n"))], F.lit(f"{a}|{b}"))


def rule_data_quality(df: DataFrame, label: str, index: str) -> DataFrame:
    """Missing labels or index values and repeated index values: P0; missing features and repeated rows: P1."""
    features = [c for c in df.columns if c not in (label, index)]
    n = lambda c: F.count_if(F.col(c).isNull())
    counts = df.agg(n(label).alias("label"), n(index).alias("index"), reduce(lambda p, q: p + q, (n(c) for c in features)).alias("features"))
    repeats = df.where(F.col(index).isNotNull()).groupBy(index).agg(F.count("*").alias("m")).agg(F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("index_repeats"))
    same = df.groupBy(*df.columns).agg(F.count("*").alias("m")).agg(F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("row_repeats"))
    one = counts.crossJoin(repeats).crossJoin(same)  # one row each
    names = [("label", "P0", "missing_label"), ("index", "P0", "missing_index"), ("index_repeats", "P0", "repeated_index"), ("features", "P1", "missing_features"), ("row_repeats", "P1", "repeated_rows")]
    return _rows(one, [("quality", p, r, F.col(c) > 0, F.col(c)) for c, p, r in names], F.lit("table"))


def rules_all(df: DataFrame, attrs: list[str], label: str, index: str) -> DataFrame:
    profile = attribute_profile(df, attrs, label)
    parts = [rule_sensitive_adequacy(profile), rule_representation(profile), rule_data_quality(df, label, index)]
    parts += [rule_intersections(df, a, b) for i, a in enumerate(attrs) for b in attrs[i + 1 :]]
    return reduce(DataFrame.unionByName, parts)


def triage_counts(recommendations: DataFrame) -> DataFrame:
    return recommendations.groupBy("category", "priority").agg(F.count("*").alias("n"))


def readiness(recommendations: DataFrame) -> DataFrame:
    """Any P0: not ready; any P1: with caveats; else ready."""
    t = recommendations.agg(F.count_if(F.col("priority") == "P0").alias("p0"), F.count_if(F.col("priority") == "P1").alias("p1"))
    return t.select(F.when(F.col("p0") > 0, "not_ready").when(F.col("p1") > 0, "with_caveats").otherwise("ready").alias("status"), "p0", "p1")


#: Support of a class, complexity that counts as high, divergence of a group, and the measures that the rules read.
CLASS_SUPPORT, HIGH, DIVERGENCE = 20, 0.5, 0.2
OVERLAP_MEASURES, LINEAR_MEASURES = ("F2", "N3", "N4", "T1"), ("L1", "L2", "L3", "T1")


def rule_task_framing(df: DataFrame, attrs: list[str], target: str, complexity: DataFrame) -> DataFrame:
    """For more than two classes: P1 if a group has few rows of a class, else P2 if a measure of `complexity` is high; none for two."""
    long = df.where(F.col(target).isNotNull()).select(F.col(target).alias("_y"), F.inline(F.array(*(F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("grp")) for a in attrs)))).where("grp IS NOT NULL")
    few = long.groupBy("attr", "grp", "_y").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") < CLASS_SUPPORT).alias("few"))
    high = complexity.agg(F.count_if(F.col("value") > HIGH).alias("high"))
    t = df.agg(F.count_distinct(target).alias("classes")).crossJoin(few).crossJoin(high).where("classes > 2")  # one row each
    rules = [("framing", "P1", "low_support", F.col("few") > 0, F.col("few")), ("framing", "P2", "high_complexity", (F.col("few") == 0) & (F.col("high") > 0), F.col("high"))]
    return _rows(t, rules, F.lit(target))


def rule_overlap(complexity: DataFrame, groups: DataFrame, reference: DataFrame) -> DataFrame:
    """P1 for measures above the upper quartile of the reference, or above a half without one; P2 for groups that differ from the whole.

    `complexity` has (metric, value), `groups` (attr, grp, metric, value), `reference` (metric, p75).
    """
    known = complexity.where(F.col("metric").isin(*OVERLAP_MEASURES)).join(F.broadcast(reference.select("metric", "p75")), "metric", "left")  # a row for each measure
    elevated = _rows(known, [("overlap", "P1", "elevated", F.col("value") > F.coalesce("p75", F.lit(HIGH)), F.col("value"))], F.col("metric"))
    whole = complexity.where("value <> 0").select("metric", F.col("value").alias("_whole"))
    apart = groups.join(F.broadcast(whole), "metric").withColumn("d", F.abs(F.col("value") - F.col("_whole")) / F.abs("_whole"))
    return elevated.unionByName(_rows(apart, [("overlap", "P2", "group_differs", F.round("d", 9) > DIVERGENCE, F.col("d"))], F.concat_ws("=", "attr", "grp")))


def rule_explainability(complexity: DataFrame) -> DataFrame:
    """P2 for each measure of linearity or structure above a half."""
    t = complexity.where(F.col("metric").isin(*LINEAR_MEASURES))
    return _rows(t, [("explainability", "P2", "hard_to_explain", F.col("value") > HIGH, F.col("value"))], F.col("metric"))
