"""How hard a table is to classify: overlap, neighbourhood and linear measures, of the whole table or of each group.

All groups are measured by the same jobs: the group is part of every key.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilens.operators import models as M
from equilens.operators.neighbours import knn_join, knn_labels, knn_lists, written

#: Rows that a group must have.
LEAST_ROWS = 50
#: Neighbours for Raug, of which more than RAUG_OTHERS in the other class count; the depth of the search for Bayes.
RAUG_K, RAUG_OTHERS, BAYES_DEPTH = 5, 2, 100
#: Groups whose linear models are fitted at once.
PARALLEL = 4
#: The measures that are repeated under a second name.
ALIASED = ("F2", "F3", "F4", "N2", "N3", "N4", "Raug", "L1", "L2", "L3", "T1")


def _long(df: DataFrame, by: str, columns: dict[str, Column]) -> DataFrame:
    return df.select(by, F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.round(c.cast("double"), 6).alias("value")) for n, c in columns.items()))))


def overlap(df: DataFrame, by: str, features: list[str], label: str) -> DataFrame:
    """(by, metric, value) for F2, F3 and F4: the volume of the classes' overlap, the least share of rows in one feature's overlap, and the share in all. Null where a class is missing."""
    v = lambda f, k: F.when(F.col(label) == k, F.col(f).cast("double"))
    bounds = df.groupBy(by).agg(*(a(v(f, k)).alias(f"{n}{k}_{i}") for i, f in enumerate(features) for k in (0, 1) for n, a in (("lo", F.min), ("hi", F.max))))
    sides = {}
    for i in range(len(features)):
        both = F.col(f"lo0_{i}").isNotNull() & F.col(f"lo1_{i}").isNotNull()
        low, high = F.greatest(f"lo0_{i}", f"lo1_{i}"), F.least(f"hi0_{i}", f"hi1_{i}")
        width = F.greatest(f"hi0_{i}", f"hi1_{i}") - F.least(f"lo0_{i}", f"lo1_{i}")
        share = F.when(width > 0, F.greatest(F.lit(0.0), high - low) / width).otherwise(1.0)
        sides |= {f"a{i}": F.when(both, low), f"b{i}": F.when(both, high), f"s{i}": F.when(both, share)}
    sides = bounds.select(by, *(c.alias(n) for n, c in sides.items()))
    inside = [F.coalesce(F.col(f).cast("double").between(F.col(f"a{i}"), F.col(f"b{i}")), F.lit(False)) for i, f in enumerate(features)]
    volume = reduce(lambda p, q: p * q, (F.col(f"s{i}") for i in range(len(features))))
    share = lambda c: F.count_if(c) / F.count("*")
    least = F.array_min(F.array(*map(share, inside)))
    t = df.join(F.broadcast(sides), by).groupBy(by).agg(F.first(volume).alias("f2"), least.alias("f3"), share(reduce(lambda p, q: p & q, inside)).alias("f4"))  # a row for each group
    known = lambda c: F.when(F.col("f2").isNotNull(), F.col(c))
    return _long(t, by, {"F2": F.col("f2"), "F3": known("f3"), "F4": known("f4")})


def neighbourhood(df: DataFrame, key: str, by: str, features: list[str], label: str, asked: Column | None = None) -> DataFrame:
    """(by, metric, value) for N2, N3, Raug and BayesImbalance, from the lists of the nearest rows, and N4 from one on interpolations.

    All rows are queries, or those that `asked` says; all rows of their group are searched. N2, N3 and N4 are null where a
    class isn't asked.
    """
    queries = lambda d: d if asked is None else d.where(asked)
    sizes = df.dropna(subset=[key, by, label, *features]).groupBy(F.col(by).cast("string").alias(by)).agg(*(F.count_if(F.col(label) == c).alias(f"n{c}") for c in (0, 1)))
    depth = F.least(F.lit(BAYES_DEPTH), F.col("n0") + F.col("n1") - 1)
    near = written(knn_labels(queries(df), df, key, features, RAUG_K, label, by=by))
    near = near.join(F.broadcast(sizes), by).withColumn("depth", F.greatest(depth - 1, F.lit(1)))  # a row for each group
    others = F.filter("found", lambda r: r["other"] != F.col("own"))
    k = F.least(F.lit(RAUG_K), F.col("depth").cast("int"))
    close = F.size(F.filter(F.slice("found", 1, k), lambda r: r["other"] == 1))
    near = near.select(key, by, "own", "within", "across", "across_key", "depth", "n0", "n1", k.alias("k"), close.alias("m"), F.size(others).alias("others"), (F.get("found", F.lit(0))["other"] != F.col("own")).cast("int").alias("wrong"))
    wide = (F.col("own") == 1) & (F.col("m") == F.col("k"))  # the neighbourhood widens to the first row of class 0
    first = _first_rank(near.where(wide), df, key, by, features, label)
    per = near.where(~wide).withColumn("r", F.lit(None).cast("int")).unionByName(near.where(wide).join(first, key, "left"))
    r = F.when(F.col("r") <= F.col("depth"), F.col("r"))
    m = F.when(F.col("m") == F.col("k"), F.coalesce(r - 2, F.col("depth") + 1)).otherwise(F.col("m"))
    size = F.when(F.col("m") == F.col("k"), m + 1).otherwise(F.col("k"))
    own_p, other_p = m / size, (size - m) / size
    scaled = other_p * (F.col("n0") / F.greatest("n1", F.lit(1)))
    gap = scaled / (scaled + own_p + 1e-12) - other_p / (other_p + own_p + 1e-12)
    classes = per.groupBy(by, "own").agg(F.sum("within").alias("within"), F.sum("across").alias("across"), F.avg("wrong").alias("wrong"), F.count("*").alias("n"), F.count_if(F.col("others") > RAUG_OTHERS).alias("hit"), F.avg(F.when(F.col("own") == 1, gap)).alias("gap"))
    ratio = F.col("within") / (F.col("across") + 1e-12)
    of = lambda c, name: F.coalesce(F.max(F.when(F.col("own") == c, F.col(name))), F.lit(0))
    both = lambda c: F.when(F.count("*") == 2, F.avg(c))
    t = classes.groupBy(by).agg(both(ratio / (1 + ratio)).alias("N2"), both(F.col("wrong")).alias("N3"), *(of(c, x).alias(f"{x}{c}") for c in (0, 1) for x in ("n", "hit")), F.max("gap").alias("gap"))
    imbalance = F.col("n0") / F.greatest("n1", F.lit(1))
    raug = (F.col("hit0") + imbalance * F.col("hit1")) / (imbalance + 1)
    mixed = M.interpolations(df, key, features, label, by=by)
    back = queries(mixed.withColumn("_at", -F.col(key) - 1).select(F.col("_at").alias(key), *(c for c in mixed.columns if c != key))).withColumn(key, -F.col(key) - 1)
    n4 = knn_join(written(back), df, key, features, 1, label, by=by).groupBy(by, "own").agg(F.avg((F.col("own") != F.col("other")).cast("int")).alias("e")).groupBy(by).agg(both(F.col("e")).alias("N4"))
    return _long(t, by, {"N2": F.col("N2"), "N3": F.col("N3"), "Raug": raug, "BayesImbalance": F.col("gap")}).unionByName(_long(n4, by, {"N4": F.col("N4")}))


def _first_rank(near: DataFrame, df: DataFrame, key: str, by: str, features: list[str], label: str) -> DataFrame:
    """(key, r): the rank of the nearest row of class 0 among all rows of the group, if at most BAYES_DEPTH - 1, for rows whose nearest are of class 1.

    It is one more than the rows of other classes before it. Rows of one place see the same rows, but for themselves,
    so one of them, that of the least key, is the query for all.
    """
    places = near.select(key, F.col("across").alias("_d"), F.col("across_key").alias("_i")).join(df.select(key, F.col(by).cast("string").alias(by), label, *features), key)
    rep = places.groupBy(by, *features).agg(F.min(key).alias("_rep"), F.first(label).alias(label), F.first("_d").alias("_d"), F.first("_i").alias("_i"))
    rep = written(rep.withColumnRenamed("_rep", key))
    lists = knn_lists(rep, df.where(F.col(label) != 0), key, features, BAYES_DEPTH - 1, label, by=by).select(F.col(key).alias("_rep"), "found")
    before = F.size(F.filter("found", lambda r: F.struct(r["distance"], r["neighbour"]) < F.struct("_d", "_i")))
    counted = rep.withColumnRenamed(key, "_rep").join(lists, "_rep", "left").select(by, *features, "_rep", F.coalesce(before, F.lit(0)).alias("_n"))
    # where the row of class 0 is at this place, keys decide which of its rows come before
    here = lambda c: ((F.col("_d") > 0) | (F.col(c) < F.col("_i"))).cast("int")
    rank = F.col("_n") + here("_rep") - here(key) + 1
    return places.join(counted, [by, *features]).where(F.col("_d").isNotNull() & (rank < BAYES_DEPTH)).select(key, rank.alias("r"))


def linear(df: DataFrame, key: str, by: str, features: list[str], label: str, groups: list) -> DataFrame:
    """(by, metric, value) for L1, L2 and L3 of the given groups: a linear SVM for each, PARALLEL groups at once."""

    def one(group) -> DataFrame:
        own = df.where(F.col(by).eqNullSafe(F.lit(group)))
        classes = own.where(F.col(label).isNotNull()).select(F.min(label), F.max(label)).first()
        if classes[0] == classes[1]:
            return _long(df.sparkSession.range(1).select(F.lit(group).alias(by)), by, {m: F.lit(None) for m in ("L1", "L2", "L3")})
        t = M.complexity_l(own, key, features, label).withColumn(by, F.lit(group))
        return _long(t, by, {m: F.col(m.lower()) for m in ("L1", "L2", "L3")})

    with ThreadPoolExecutor(PARALLEL) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, groups))


def by_group(df: DataFrame, key: str, by: str, features: list[str], label: str, asked: Column | None = None, least: int = LEAST_ROWS, models: bool = False) -> DataFrame:
    """(by, n, status, metric, value): every measure of each group, ok or skipped for fewer than `least` rows; `asked` as for `neighbourhood`.

    With `models` those of linear models are there too, a fit for each group, whose names come to the driver. A skipped
    group is one row without a metric. The null group counts with the name null.
    """
    df = df.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("null")))
    sizes = df.groupBy(by).agg(F.count("*").alias("n"))
    large = df.join(F.broadcast(sizes.where(F.col("n") >= least).select(by)), by)  # a row for each group
    tables = [overlap(large, by, features, label), neighbourhood(large, key, by, features, label, asked)]
    if models:
        names = [r[0] for r in sizes.where(F.col("n") >= least).orderBy(by).select(by).collect()]
        tables += [linear(large, key, by, features, label, names)] if names else []
    found = reduce(DataFrame.unionByName, tables)
    status = F.when(F.col("n") >= least, "ok").otherwise("skipped")
    return sizes.join(found, by, "left").select(by, "n", status.alias("status"), "metric", "value")


def pairs(df: DataFrame, left: str, right: str, name: str = "cell") -> DataFrame:
    """`df` with the pair of two attributes as one group, as `left=value|right=value`."""
    part = lambda c: F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return df.withColumn(name, F.concat_ws("|", part(left), part(right)))


def with_aliases(measures: DataFrame) -> DataFrame:
    """(metric, value) and the repetitions under a second name."""
    again = measures.where(F.col("metric").isin(*ALIASED)).withColumn("metric", F.concat("metric", F.lit("Imbalance")))
    return measures.unionByName(again)
