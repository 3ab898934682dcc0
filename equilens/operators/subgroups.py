"""Bins and clusters as subgroups: their impact on other attributes, sensitivity of gaps to the bins, and nearest centroids."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equilens.functions.scalars import bin_label
from equilens.operators import binning as B
from equilens.operators import fairness as A
from equilens.operators.clustering import profile
from equilens.operators.preparation import sample_stable
from equilens.operators.statistics import running

#: Rows from which a bin's rates count.
LEAST_BIN = 20


def adaptive_quantile_edges(df: DataFrame, column: str, n: int, least: int) -> list[float]:
    """Quantile edges whose small bins are merged."""
    return B.bin_repair(df, column, B.quantile_edges(df, column, n), least)


def cross_impact(df: DataFrame, attrs: list[str], target: str, by: str = "bin") -> DataFrame:
    """(attr, global_sp, max_within_bin_sp, delta): whether bins widen the gaps of other attributes. A bin with one group has no gap."""
    long = df.where(F.col(by).isNotNull()).select(by, F.col(target).alias("_y"), F.inline(F.array(*(F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("grp")) for a in attrs)))).where("grp IS NOT NULL")
    cells = long.groupBy("attr", by, "grp").agg(F.sum("_y").alias("pos"), F.count("_y").alias("n"))
    gap = F.max(F.col("pos") / F.col("n")) - F.min(F.col("pos") / F.col("n"))
    within = cells.groupBy("attr", by).agg(gap.alias("gap")).groupBy("attr").agg(F.max("gap").alias("within"))
    whole = cells.groupBy("attr", "grp").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).groupBy("attr").agg(gap.alias("overall"), F.count("*").alias("groups"))
    t = whole.where("groups > 1").join(within, "attr")
    r = lambda c: F.bround(c, 4)
    return t.select("attr", r(F.col("overall")).alias("global_sp"), r(F.col("within")).alias("max_within_bin_sp"), r(F.col("within") - F.col("overall")).alias("delta"))


def bin_analysis(df: DataFrame, column: str, target: str, attrs: list[str], by: str = "bin") -> DataFrame:
    """(section, item, value): sizes and rates of the bins, their fairness, and their impact on other attributes, as one tidy table."""
    stats, fair, impact = B.bin_stats(df, column, target, by), B.bin_fairness(df, target, by), cross_impact(df, attrs, target, by)
    part = lambda t, section, item, value: t.select(F.lit(section).alias("section"), F.col(item).cast("string").alias("item"), F.col(value).cast("double").alias("value"))
    names = ("cv", "gap", "dp_ratio", "max_deviation")
    listed = fair.select(F.inline(F.array(*(F.struct(F.lit(n).alias("item"), F.col(n).alias("value")) for n in names))))
    parts = [part(stats, "size", by, "n"), part(stats, "rate", by, "rate"), part(listed, "fairness", "item", "value"), part(impact, "impact", "attr", "delta")]
    return reduce(DataFrame.unionByName, parts)


def bin_recommend(df: DataFrame, target: str, by: str = "bin") -> DataFrame:
    """A recommendation if the rates of the highest and the lowest bin are far apart; none otherwise."""
    return B.bin_disparity(df, target, by).where("priority IS NOT NULL").select("priority", "highest", "lowest", "ratio")


def labelled_bins(df: DataFrame, column: str, edges: list[float], whole: bool) -> DataFrame:
    """(bin, label): bins as they are shown."""
    t = B.bin_apply(df, column, edges).where("bin IS NOT NULL").groupBy("bin").agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    edge = lambda i: F.get(F.array(*map(F.lit, edges)), i)
    return t.select("bin", bin_label(edge(F.col("bin")), edge(F.col("bin") + 1), F.col("lo"), F.col("hi"), whole).alias("label"))


def age_sensitivity(df: DataFrame, strategies: dict[str, list[float]], age: str, key: str, keys: list[str], consistency: DataFrame) -> DataFrame:
    """(keys, strategy, bin, n, positive_rate, gaps, mean_consistency, low_n): how the gaps depend on how ages are cut.

    `df` has y_true and y_pred for each of `keys` (regime, model); `consistency` has (keys, key, consistency) of the rows
    that were asked, and is computed once for all strategies.
    """
    each = F.array(*(F.struct(F.lit(n).alias("strategy"), B.bin_index(F.col(age), e).alias("bin")) for n, e in strategies.items()))
    binned = df.select(*keys, key, "y_true", "y_pred", F.inline(each)).where("bin IS NOT NULL")
    counts = A.rates(A.group_counts(binned.withColumn("_bin", F.col("bin").cast("string")), ["_bin"], [*keys, "strategy"]))
    w = Window.partitionBy(*keys, "strategy")  # a row for each bin
    gap = lambda m: F.round(F.max(m).over(w) - F.min(m).over(w), 6)
    t = counts.select(*keys, "strategy", F.col("grp").cast("int").alias("bin"), "n", F.round("positive_rate", 6).alias("positive_rate"), gap("positive_rate").alias("dp_gap"), gap("tpr").alias("eo_tpr_gap"), gap("fpr").alias("eo_fpr_gap"))
    asked = consistency.join(binned.select(*keys, key, "strategy", "bin"), [*keys, key]).groupBy(*keys, "strategy", "bin").agg(F.round(F.avg("consistency"), 6).alias("mean_consistency"))
    return t.join(asked, [*keys, "strategy", "bin"], "left").withColumn("low_n", F.col("n") < LEAST_BIN)


def age_sensitivity_summary(grid: DataFrame, keys: list[str]) -> DataFrame:
    return grid.groupBy(*keys, "strategy").agg(F.count("*").alias("bins"), F.count_if("low_n").alias("low_n"), F.max("dp_gap").alias("dp_gap"))


def age_sensitivity_deltas(grid: DataFrame, keys: list[str], metric: str = "dp_gap") -> DataFrame:
    """`metric` before and after for each strategy and bin, and its change."""
    of = lambda r: F.max(F.when(F.col("regime") == r, F.col(metric)))
    t = grid.groupBy(*keys, "strategy", "bin").agg(of("before").alias("before"), of("after").alias("after"))
    return t.withColumn("delta", F.round(F.col("after") - F.col("before"), 6))


def cumulative_hits(neighbours: DataFrame, key: str) -> DataFrame:
    """(key, rank, hits): how many of the nearest neighbours up to a rank share the row's label; k rows a query."""
    w = Window.partitionBy(key).orderBy("rank")
    return neighbours.select(key, "rank", F.sum((F.col("own") == F.col("other")).cast("int")).over(w).alias("hits"))


def top_cluster_features(profile: DataFrame, k: int = 3, by_deviation: bool = False) -> DataFrame:
    """(cluster, rank, feature, difference): the k features in which a cluster is farthest from the whole, by its mean or in its deviations."""
    d = F.abs(F.col("mean") - F.col("overall"))
    d = F.when(F.col("std") > 0, d / F.col("std")) if by_deviation else d
    w = Window.partitionBy("cluster").orderBy(F.desc_nulls_last("difference"), "feature")  # a row for each feature
    t = profile.withColumn("difference", F.round(d, 4)).withColumn("rank", F.row_number().over(w))
    return t.where(F.col("rank") <= k).select("cluster", "rank", "feature", "difference")


def top_features(importances: DataFrame, k: int) -> DataFrame:
    """The k features of largest absolute importance, ranked."""
    t = importances.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("importance")), "feature")))  # a row for each feature
    return t.where(F.col("rank") <= k).select("rank", "feature", "importance")


def cluster_list(clustered: DataFrame, features: list[str], target: str) -> DataFrame:
    """Size, share and outcome rate of each cluster, and its dominant feature."""
    first = top_cluster_features(profile(clustered, features, target), 1, True).select("cluster", F.col("feature").alias("dominant"))
    g = clustered.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg(F.col(target).cast("double")), 6).alias("rate"))
    pct = F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4)  # a row for each cluster
    return g.withColumn("pct", pct).join(first, "cluster")


def centroids_of(rows: DataFrame, cluster: str, features: list[str]) -> DataFrame:
    return rows.groupBy(F.col(cluster).alias("cluster")).agg(*(F.avg(f).alias(f) for f in features))


def nearest_centroid_join(rows: DataFrame, centroids: DataFrame, features: list[str]) -> DataFrame:
    """`rows` with the nearest cluster and its distance; ties go to the first cluster. The centroids are one row of an array."""
    listed = centroids.agg(F.array_sort(F.collect_list(F.struct("cluster", F.array(*features).alias("at")))).alias("_all"))  # a row for each cluster
    square = lambda at: reduce(lambda p, q: p + q, ((F.col(f) - at[i]) * (F.col(f) - at[i]) for i, f in enumerate(features)))
    best = F.array_min(F.transform("_all", lambda c: F.struct(F.round(F.sqrt(square(c["at"])), 9).alias("distance"), c["cluster"].alias("cluster"))))
    return rows.crossJoin(F.broadcast(listed)).withColumn("_best", best).select(*rows.columns, F.col("_best.cluster").alias("cluster"), F.col("_best.distance").alias("distance"))


def cluster_assign_test(train: DataFrame, test: DataFrame, cluster: str, features: list[str]) -> DataFrame:
    """`test` rows with the nearest cluster of the training rows; scales and centroids come from training rows alone."""
    stats = train.agg(*(F.avg(f).alias(f"{f}__m") for f in features), *(F.stddev_pop(f).alias(f"{f}__s") for f in features))

    def scaled(df: DataFrame) -> DataFrame:
        z = {f: F.when(F.col(f"{f}__s") > 0, (F.col(f) - F.col(f"{f}__m")) / F.col(f"{f}__s")).otherwise(0.0) for f in features}
        return df.crossJoin(F.broadcast(stats)).withColumns(z).select(*df.columns)  # one row

    return nearest_centroid_join(scaled(test).drop(cluster), centroids_of(scaled(train), cluster, features), features)


def rank_average(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, rank, share): the rank of a value, ties averaged and nulls last, and the rank over the number of rows."""
    v = F.col(column).cast("double")
    n = df.agg(F.count("*").alias("_all"), F.count(v).alias("_known"))  # one row
    counts = df.where(v.isNotNull()).groupBy(v.alias("_v")).agg(F.count("*").alias("_m"))
    places = running(counts, [], "_v", {"_m": "_to"}).select("_v", (F.col("_to") - (F.col("_m") - 1) / 2).alias("rank"))
    t = df.select(key, v.alias("_v")).join(places, "_v", "left").crossJoin(F.broadcast(n))
    last = (F.col("_known") + 1 + F.col("_all")) / 2
    rank = F.coalesce("rank", last)
    return t.select(key, rank.alias("rank"), F.round(rank / F.col("_all"), 9).alias("share"))


def complexity_f_by(df: DataFrame, keys: list[str], feature: str, target: str, least: int = A.LEAST_ROWS) -> DataFrame:
    """(keys, n, f2, f3, f4, status) of each group for one feature; groups with fewer than `least` rows are skipped."""
    v = lambda k: F.when(F.col(target) == k, F.col(feature).cast("double"))
    b = df.groupBy(*keys).agg(F.count("*").alias("n"), *(f(v(k)).alias(f"{n}{k}") for k in (0, 1) for n, f in (("lo", F.min), ("hi", F.max))))
    low, high = F.greatest("lo0", "lo1"), F.least("hi0", "hi1")
    two = F.col("lo0").isNotNull() & F.col("lo1").isNotNull()
    width = F.greatest("hi0", "hi1") - F.least("lo0", "lo1")
    b = b.select(*keys, "n", F.when(two, low).alias("_a"), F.when(two, high).alias("_b"), F.when(two & (width > 0), F.greatest(F.lit(0.0), high - low) / width).when(two, 1.0).alias("_f2"))
    inside = F.count_if(F.col(feature).cast("double").between(F.col("_a"), F.col("_b"))) / F.count("*")
    g = df.join(F.broadcast(b.drop("n")), keys).groupBy(*keys).agg(F.count("*").alias("n"), F.first("_f2").alias("_f2"), F.when(F.first("_a").isNotNull(), inside).alias("_in"))  # a row for each group
    kept = lambda c: F.when(F.col("n") >= least, F.round(c, 6))
    return g.select(*keys, "n", kept("_f2").alias("f2"), kept("_in").alias("f3"), kept("_in").alias("f4"), F.when(F.col("n") >= least, "ok").otherwise("skipped").alias("status"))


def with_generators(df: DataFrame, generators: list) -> DataFrame:
    """`df` after each of the user's functions that add columns of groups; an error in one is raised."""
    return reduce(lambda d, g: d.transform(g), generators, df)


def spheres(rows: np.ndarray, radii: np.ndarray, stop: int = 100) -> int:
    """How many spheres around rows, the widest first, cover a class: a small helper over the rows of a bounded sample.

    When the last `stop` spheres have hardly covered more than their own row, each row that is left counts as one.
    """
    left, n, sizes = np.ones(len(rows), bool), 0, []
    for i in np.lexsort((np.arange(len(radii)), -radii)):
        if not left[i]:
            continue
        n += 1
        sizes.append(int(left.sum()))
        far = np.sqrt(((rows - rows[i]) ** 2).sum(1)) > radii[i]
        left &= far
        left[i] = False
        last = sizes[-stop:]
        if len(last) == stop and np.abs(np.diff(last)).mean() < 1.5:
            return n + int(left.sum())
    return n


def t1(df: DataFrame, key: str, features: list[str], label: str, sample: int = 600) -> DataFrame:
    """Spheres that cover each class without touching the other, over its rows, averaged over two classes.

    The cover is greedy, row after row, so it runs on a stable sample of `sample` rows, a parameter of the measure; null for one class.
    """
    usable = df.select(F.col(key), F.col(label).cast("long"), *(F.col(f).cast("double") for f in features)).dropna()
    drawn = sample_stable(usable, key, sample)

    def cover(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key)
        x = [part[part[label] == c][features].to_numpy(float) for c in (0, 1)]
        if min(map(len, x)) == 0:
            return pd.DataFrame({"t1": [None]}, dtype=float)
        far = np.sqrt(((x[0][:, None] - x[1][None]) ** 2).sum(2))
        return pd.DataFrame({"t1": [round((spheres(x[0], far.min(1)) / len(x[0]) + spheres(x[1], far.min(0)) / len(x[1])) / 2, 6)]})

    return drawn.groupBy(F.lit(1).alias("_one")).applyInPandas(cover, "t1 double")  # `sample` rows


def sweep_grid(done: DataFrame, choices: dict[str, list[str]], unsupported: list[tuple[str, str, str, str]]) -> DataFrame:
    """All configurations but the unsupported pairs, with the number of experiments that exist for each dataset, mitigation and model.

    A pair is (column, value, column, value); the grid is the product of short lists.
    """
    grid = done.sparkSession.range(1).select(*(F.array(*map(F.lit, v)).alias(k) for k, v in choices.items()))
    for k in choices:
        grid = grid.withColumn(k, F.explode(k))
    for a, x, b, y in unsupported:
        grid = grid.where(~((F.col(a) == x) & (F.col(b) == y)))
    keys = ["dataset", "mitigation", "model"]
    counts = done.groupBy("dataset", "mitigation", F.col("model_type").alias("model")).agg(F.count("*").alias("experiments"))
    return grid.join(counts, keys, "left").select(*choices, "experiments")
