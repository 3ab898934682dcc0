"""Overlap and lineage between sources: sets, multisets and occurrence matching, null-safe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def multiset_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in common with multiplicity, by counts of each side in one grouping: null keys are equal."""
    both = a.withColumn("_a", F.lit(1)).unionByName(b.withColumn("_a", F.lit(0)))
    t = both.groupBy(*a.columns).agg(F.sum("_a").alias("na"), F.sum(1 - F.col("_a")).alias("nb"))
    s = t.agg(F.coalesce(F.sum(F.least("na", "nb")), F.lit(0)).alias("overlap"), F.coalesce(F.sum("na"), F.lit(0)).alias("rows_a"), F.coalesce(F.sum("nb"), F.lit(0)).alias("rows_b"))
    pct = lambda n: F.round(F.when(F.col(n) > 0, 100 * F.col("overlap") / F.col(n)).otherwise(0.0), 4)
    return s.select("overlap", "rows_a", "rows_b", pct("rows_a").alias("pct_a"), pct("rows_b").alias("pct_b"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows missing from b and unexpected in it, each as often as it is over."""
    keys = a.columns
    side = lambda x, name: x.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("side", F.lit(name))
    return side(a.exceptAll(b), "missing").unionByName(side(b.exceptAll(a), "unexpected"))


def union_lineage_audit(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.distinct().withColumn("_a", F.lit(1)).unionByName(b.distinct().withColumn("_a", F.lit(0)))
    t = both.groupBy(*a.columns).agg(F.sum("_a").alias("a"), F.sum(1 - F.col("_a")).alias("b"))
    return t.agg(F.count("*").alias("n_union"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("n_both"), F.count_if(F.col("b") == 0).alias("only_a"), F.count_if(F.col("a") == 0).alias("only_b"))


def set_overlap_matrix(df: DataFrame, source: str, keys: list[str]) -> DataFrame:
    """Distinct keys that each ordered pair of sources shares, by the set of sources of each key."""
    t = df.groupBy(*keys).agg(F.array_sort(F.collect_set(source)).alias("s"))
    sets = t.groupBy("s").agg(F.count("*").alias("n"))  # as many rows as combinations of sources
    pairs = sets.select("n", F.explode("s").alias("a"), "s").select("n", "a", F.explode("s").alias("b"))
    m = pairs.groupBy("a", "b").agg(F.sum("n").alias("shared"))
    own = F.max(F.when(F.col("a") == F.col("b"), F.col("shared"))).over(Window.partitionBy("a"))
    return m.select("a", "b", "shared", F.round(100 * F.col("shared") / own, 4).alias("pct_of_a"))


def occurrence_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """One-to-one matches of equal rows: counts of both, left_only and right_only; by counts of each key, rows aren't numbered."""
    both = a.withColumn("_a", F.lit(1)).unionByName(b.withColumn("_a", F.lit(0)))
    t = both.groupBy(*a.columns).agg(F.sum("_a").alias("na"), F.sum(1 - F.col("_a")).alias("nb"))
    sides = {"both": F.least("na", "nb"), "left_only": F.greatest(F.col("na") - F.col("nb"), F.lit(0)), "right_only": F.greatest(F.col("nb") - F.col("na"), F.lit(0))}
    s = t.agg(*(F.sum(c).alias(n) for n, c in sides.items()))
    return s.select(F.inline(F.array(*(F.struct(F.lit(n).alias("side"), F.col(n).alias("n")) for n in sides)))).where("n > 0")


def union_splits(parts: dict[str, DataFrame], name: str = "split") -> DataFrame:
    """The rows of all parts, each with its part's name; columns that one lacks are null."""
    named = [df.withColumn(name, F.lit(k)) for k, df in parts.items()]
    return reduce(lambda p, q: p.unionByName(q, allowMissingColumns=True), named)


def join_on_rows(left: DataFrame, right: DataFrame, key: str, columns: list[str], how: str = "left") -> DataFrame:
    """`left` with `columns` of the row of `right` that has the same key: cluster labels, raw values, features of a fold."""
    return left.join(right.select(key, *columns), key, how)


def join_raw_meta(scaled: DataFrame, raw: DataFrame, key: str, columns: list[str], target: str) -> DataFrame:
    """Scaled rows with the raw values of their row as <column>_raw. An error if keys or targets of the two don't agree."""
    t = scaled.join(raw.select(key, F.col(target).alias("_t"), *(F.col(c).alias(f"{c}_raw") for c in columns)), key, "left")
    same = F.col("_t").eqNullSafe(F.col(target))
    checked = F.when(same, F.col(target)).otherwise(F.raise_error(F.concat(F.lit("targets differ at row "), F.col(key).cast("string"))))
    return t.withColumn(target, checked).drop("_t")


def join_patient_split(rows: DataFrame, chosen: DataFrame, group: str) -> DataFrame:
    """The rows of the chosen groups."""
    return rows.join(chosen.select(group).distinct(), group, "left_semi")


def leaked_groups(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """Groups that are on both sides of a split: there should be none."""
    return a.select(group).intersect(b.select(group))


def cohort_build(sites: dict[str, DataFrame], keys: list[str], order: list[str], expected: int | None = None) -> DataFrame:
    """The rows of all sites, tagged, without repeated keys: the first site wins, then `order`.

    If the number of rows isn't the expected one the cohort isn't built: an error is raised before anything is written.
    """
    place = {name: i for i, name in enumerate(sites)}
    tagged = union_splits({n: df.withColumn("_site_order", F.lit(i)) for (n, df), i in zip(sites.items(), place.values())}, "source_site")
    cohort = dedup_keep_first(tagged, keys, ["_site_order", *order]).drop("_site_order")
    if expected is not None and (n := cohort.count()) != expected:
        raise ValueError(f"the cohort has {n} rows, not {expected}")
    return cohort


def provenance_report(raw: DataFrame, cohort: DataFrame, key: str, required: list[str], ranges: dict[str, tuple[float, float]], target: str) -> DataFrame:
    """(check, value, holds): dropped rows are just those that lack a required value, ranges hold, and the balance of the target."""
    lacks = reduce(lambda p, q: p | q, (F.col(c).isNull() for c in required))
    sides = raw.withColumn("_lacks", lacks).join(cohort.select(key, F.lit(True).alias("_in")), key, "left")
    wrong = sides.agg(F.count_if(F.col("_lacks") == F.coalesce("_in", F.lit(False))).alias("n"))
    parts = [wrong.select(F.lit("dropped_are_incomplete").alias("check"), F.col("n").cast("double").alias("value"), (F.col("n") == 0).alias("holds"))]
    outside = cohort.agg(*(F.count_if(~F.col(c).between(lo, hi)).alias(c) for c, (lo, hi) in ranges.items()))
    parts.append(outside.select(F.inline(F.array(*(F.struct(F.concat(F.lit("range_"), F.lit(c)).alias("check"), F.col(c).cast("double").alias("value"), (F.col(c) == 0).alias("holds")) for c in ranges)))))
    parts.append(cohort.agg(F.lit("positive_share").alias("check"), F.round(F.avg(target), 6).alias("value"), F.avg(target).between(0.2, 0.8).alias("holds")))
    return reduce(DataFrame.unionByName, parts)


def dedup_keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`, as an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    t = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_v"))
    return t.select(*keys, "_v.*").select(*df.columns)


def mapping_verification(pairs: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows that break each rule: its two columns aren't equal, nulls being equal."""
    row = pairs.agg(*(F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(n) for n, (a, b) in rules.items()))
    return row.select(F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("mismatches")) for n in rules))))
