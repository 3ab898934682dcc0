"""Tests over value counts: chi-square, Cramér's V, Kolmogorov-Smirnov, Mann-Whitney; and complexity measures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Values of one slice of `running`.
SLICE = 100_000


def running(df: DataFrame, keys: list[str], order: str, sums: dict[str, str], slice_rows: int = SLICE, previous: str | None = None) -> DataFrame:
    """`df` with running sums of columns in the order of a numeric column within `keys`, without a task for each key.

    Rows are cut into ranges of the order, sums run within a range, and each range starts with the totals of those
    before it. Ranges come from approximate quantiles over all keys; ties must be one row, as counts of values are.
    `previous` names a column for the order of the row before, null at a key's first row.
    """
    n = df.count()
    slices = max(1, n // slice_rows)
    cuts = df.agg(F.percentile_approx(order, [i / slices for i in range(1, slices)], 10 * slices)).first()[0] if slices > 1 else []
    at = F.lit(0)
    if cuts:  # one number for each slice
        edges = np.unique(np.array(cuts, float))
        place = F.pandas_udf(lambda v: pd.Series(np.searchsorted(edges, v.to_numpy(), side="left").astype(np.int32)), "int")
        at = place(F.col(order).cast("double"))
    part = df.withColumn("_slice", at.cast("int"))
    totals = part.groupBy(*keys, "_slice").agg(*(F.sum(c).alias(f"{c}__t") for c in sums), F.max(order).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_slice", *(F.coalesce(F.sum(f"{c}__t").over(before), F.lit(0)).alias(f"{c}__s") for c in sums), F.max("_last").over(before).alias("_last"))
    by_order = Window.partitionBy(*keys, "_slice").orderBy(order)
    within = by_order.rowsBetween(Window.unboundedPreceding, 0)
    own = part.withColumns({out: F.sum(c).over(within) for c, out in sums.items()} | ({previous: F.lag(order).over(by_order)} if previous else {}))
    t = own.join(starts, [*keys, "_slice"])
    t = t.withColumn(previous, F.coalesce(previous, "_last")) if previous else t
    return t.withColumns({out: F.col(out) + F.col(f"{c}__s") for c, out in sums.items()}).drop("_slice", "_last", *(f"{c}__s" for c in sums))


def quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    """(keys, q): exact quantiles, linear between neighbours, as an array for each key; over the counts of distinct values.

    Null values don't count. No buffer holds the values of a key: they are found by their running counts.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_m"))
    whole = counts.groupBy(*keys).agg(F.sum("_m").alias("_all"))
    t = running(counts, keys, "_v", {"_m": "_to"})
    t = t.join(F.broadcast(whole), keys) if keys else t.crossJoin(F.broadcast(whole))  # a row for each key
    found = []
    for q in qs:
        at = (F.col("_all") - 1) * q
        value_at = lambda i: F.max(F.when((F.col("_to") - F.col("_m") <= i) & (i < F.col("_to")), F.col("_v")))
        low, high = value_at(F.floor(at)), value_at(F.ceil(at))
        found.append(low + (high - low) * F.max(at - F.floor(at)))
    return t.groupBy(*keys).agg(F.array(*found).alias("q"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Statistic (Yates-corrected for 2 x 2), degrees of freedom and Cramér's V, from the contingency table."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    rows, cols = t.groupBy("a").agg(F.sum("o").alias("ra")), t.groupBy("b").agg(F.sum("o").alias("cb"))
    n = Window.partitionBy()
    grid = rows.crossJoin(cols).join(t, ["a", "b"], "left").withColumn("o", F.coalesce("o", F.lit(0)))  # groups x groups, not rows
    g = grid.withColumns({"n": F.sum("o").over(n), "k": F.size(F.collect_set("a").over(n)), "m": F.size(F.collect_set("b").over(n))})
    e = F.col("ra") * F.col("cb") / F.col("n")
    d = F.abs(F.col("o") - e)
    d = F.when((F.col("k") == 2) & (F.col("m") == 2), d - F.least(F.lit(0.5), d)).otherwise(d)
    s = g.agg(F.sum(d * d / e).alias("chi2"), F.max("n").alias("n"), F.max("k").alias("k"), F.max("m").alias("m"))
    v = F.sqrt(F.col("chi2") / (F.col("n") * F.greatest(F.least("k", "m") - 1, F.lit(1))))
    return s.select(F.round("chi2", 4).alias("chi2"), ((F.col("k") - 1) * (F.col("m") - 1)).cast("long").alias("dof"), F.round(F.least(v, F.lit(1.0)), 6).alias("cramers_v"), "n")


#: Terms of the series of Kolmogorov's distribution.
TERMS = 30


def ks_long(df: DataFrame, keys: list[str], first: Column, value: str) -> DataFrame:
    """(keys, ks, p, n_a, n_b): the two-sample statistic and its asymptotic p for each key.

    The largest distance of the two distribution functions, over the counts of distinct values.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count_if(first).alias("x"), F.count_if(~first).alias("y"))
    t = running(counted, keys, "v", {"x": "fx", "y": "fy"})
    whole = counted.groupBy(*keys).agg(F.sum("x").alias("n_a"), F.sum("y").alias("n_b")).where("n_a > 0 AND n_b > 0")
    joined = t.join(F.broadcast(whole), keys) if keys else t.crossJoin(F.broadcast(whole))  # a row for each key
    d = F.abs(F.col("fx") / F.col("n_a") - F.col("fy") / F.col("n_b"))
    k = joined.groupBy(*keys).agg(F.max(d).alias("d"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    root = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b"))) * F.col("d")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), F.lit(0.0), lambda acc, i: acc + F.when(i % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * i * i * root * root))
    p = F.when(root < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series)))
    return k.select(*keys, F.round("d", 6).alias("ks"), F.round(p, 6).alias("p"), "n_a", "n_b")


def ks(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """Kolmogorov-Smirnov statistic of two groups."""
    return ks_long(df.where(F.col(group).isin(a, b)), [], F.col(group) == a, value).select("ks", "n_a", "n_b")


def mann_whitney(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """U of group a over b, by mid-ranks of value counts."""
    t = df.where(F.col(value).isNotNull() & F.col(group).isin(a, b)).groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(group) == a).alias("x"), F.count_if(F.col(group) == b).alias("y"))
    below = F.col("fy") - F.col("y")
    u = running(t, [], "v", {"y": "fy"}).withColumn("u", F.col("x") * (below + F.col("y") / 2)).agg(F.sum("u").alias("u"), F.sum("x").alias("n_a"), F.sum("y").alias("n_b"))
    return u.select(F.round("u", 1).alias("u"), "n_a", "n_b", F.round(F.col("u") / (F.col("n_a") * F.col("n_b")), 6).alias("effect"))


def _ranges(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row with the bounds of the overlap of the two classes for each feature."""
    agg = []
    for f in features:
        for k in (0, 1):
            v = F.when(F.col(target) == k, F.col(f).cast("double"))
            agg += [F.min(v).alias(f"{f}__lo{k}"), F.max(v).alias(f"{f}__hi{k}")]
    row = df.agg(*agg)
    cols = {}
    for f in features:
        cols |= {f"{f}__a": F.greatest(f"{f}__lo0", f"{f}__lo1"), f"{f}__b": F.least(f"{f}__hi0", f"{f}__hi1"), f"{f}__w": F.greatest(f"{f}__hi0", f"{f}__hi1") - F.least(f"{f}__lo0", f"{f}__lo1")}
    return row.select(*(c.alias(n) for n, c in cols.items()))


def complexity_f(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """F2 (volume of the overlap), F3 (least share of rows in one feature's overlap), F4 (share of rows in all overlaps)."""
    bounds = _ranges(df, features, target)
    f2 = None
    for f in features:
        part = F.when(F.col(f"{f}__w") > 0, F.greatest(F.lit(0.0), F.col(f"{f}__b") - F.col(f"{f}__a")) / F.col(f"{f}__w")).otherwise(1.0)
        f2 = part if f2 is None else f2 * part
    inside = [F.col(f).cast("double").between(F.col(f"{f}__a"), F.col(f"{f}__b")) for f in features]
    every = inside[0]
    for i in inside[1:]:
        every = every & i
    t = df.select(*features).crossJoin(F.broadcast(bounds))  # one row of bounds
    share = lambda c: F.count_if(c) / F.count("*")
    g = t.agg(F.round(F.first(f2), 6).alias("f2"), F.round(F.least(*(share(i) for i in inside)) if len(inside) > 1 else share(inside[0]), 6).alias("f3"), F.round(share(every), 6).alias("f4"))
    return g
