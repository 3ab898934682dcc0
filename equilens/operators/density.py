"""Clusters by density, on a grid of cells."""

from __future__ import annotations

import itertools
import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equilens.operators.graph import checkpointed, components, hot_join
from equilens.operators.places import ROWS, silhouette

#: The cluster of rows that are near no dense place.
NOISE = -1
#: Pairs of rows that two pieces may have to be compared row by row.
SMALL = 10_000
#: Settings that are tried at once.
PARALLEL = 4
#: Share of noise above which a setting is rejected.
MOST_NOISE = 0.3


def _cells(features: list[str], side: float) -> Column:
    return F.array(*(F.floor(F.col(f) / side).cast("long") for f in features))


def _pieces(cores: DataFrame, features: list[str], side: float, level: int) -> DataFrame:
    """(head, sub, n, lo, hi, ends): for each piece of a cell, cut in halves `level` times along each feature, its rows, bounds and outermost rows."""
    sub = cores.withColumn("sub", _cells(features, side / 2**level))
    at = F.array(*features)
    ends = F.array(*(f(at, F.col(x)) for x in features for f in (F.min_by, F.max_by)))
    return sub.groupBy("head", "sub").agg(F.count("*").alias("n"), F.array(*(F.min(f) for f in features)).alias("lo"), F.array(*(F.max(f) for f in features)).alias("hi"), ends.alias("ends"))


def _length(parts: Column) -> Column:
    return F.round(F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x * x)), 9)


def _decided(pairs: DataFrame, eps: float) -> DataFrame:
    """Pairs (p, q) of pieces that may be linked, with `linked` where their bounds or outermost rows show it."""
    gap = F.zip_with(F.zip_with("p.lo", "q.hi", lambda a, b: a - b), F.zip_with("q.lo", "p.hi", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    span = F.zip_with(F.zip_with("p.hi", "q.lo", lambda a, b: a - b), F.zip_with("q.hi", "p.lo", lambda a, b: a - b), lambda a, b: F.greatest(a, b))
    met = F.exists("p.ends", lambda a: F.exists("q.ends", lambda b: _length(F.zip_with(a, b, lambda x, y: x - y)) <= eps))
    return pairs.where(_length(gap) <= eps).withColumn("linked", (_length(span) <= eps) | met)


def links(cores: DataFrame, features: list[str], eps: float, side: float, offsets: Column) -> DataFrame:
    """(a, b): heads of neighbouring cells with core rows within `eps` of each other; of pairs that others connect anyway some are left out.

    `cores` has (id, features, cell, head). The closest rows of two cells are not searched among all pairs: the bounds
    of cells and their outermost rows decide most pairs of cells, and those that are connected by others need no
    decision. What is left is cut into halves along each feature, round after round; pieces too far apart go, the first
    close one settles the pair of cells, and pieces of few rows are compared. So the work follows the rows near the
    edge of reach, and no task holds more than the rows of small pieces, at most SMALL pairs for two of them.
    """
    points = cores.select("head", *features).distinct()
    boxes = _pieces(points, features, side, 0)
    around = boxes.select(F.struct(*boxes.columns).alias("p"), F.explode(F.transform(offsets, lambda o: F.zip_with("sub", o, lambda a, b: a + b))).alias("sub"))
    pairs = around.join(boxes.select(F.struct(*boxes.columns).alias("q"), "sub"), "sub").drop("sub").where("p.head < q.head")
    pairs = checkpointed(_decided(pairs, eps))
    named = lambda d: d.select(F.col("p.head").alias("a"), F.col("q.head").alias("b"))
    found = checkpointed(named(pairs.where("linked")).distinct())
    component = components(found, boxes.select(F.col("head").alias("id")))
    side_of = lambda c: component.select(F.col("id").alias(c), F.col("component").alias(f"_{c}"))
    apart = named(pairs.where("NOT linked")).join(side_of("a"), "a").join(side_of("b"), "b").where("_a <> _b").select("a", "b")
    left = pairs.where("NOT linked").select("p", "q", F.col("p.head").alias("a"), F.col("q.head").alias("b")).join(apart, ["a", "b"]).drop("a", "b")
    left = checkpointed(left.select("p", "q"))
    level = 0
    while not left.isEmpty():
        few = F.col("p.n") * F.col("q.n") <= SMALL
        own = points.withColumn("sub", _cells(features, side / 2**level)).select("head", "sub", F.array(*features).alias("x"))
        ask = left.where(few).select(F.col("p.head").alias("a"), F.col("q.head").alias("b"), F.col("p.sub").alias("_p"), F.col("q.sub").alias("_q"))
        ends = [own.select(F.col("head").alias(h), F.col("sub").alias(s), F.col("x").alias(x)) for h, s, x in (("a", "_p", "_x"), ("b", "_q", "_y"))]
        near = ask.join(ends[0], ["a", "_p"]).join(ends[1], ["b", "_q"]).where(_length(F.zip_with("_x", "_y", lambda x, y: x - y)) <= eps).select("a", "b")
        level += 1
        boxes = _pieces(points, features, side, level)
        parent = boxes.select(F.struct(*boxes.columns).alias("c"), "head", F.transform("sub", lambda x: F.shiftright(x, 1)).alias("sub"))
        child = lambda d, side: d.join(parent.select(F.col("head").alias("_h"), F.col("sub").alias("_s"), F.col("c").alias(f"_{side}")), (F.col(f"{side}.head") == F.col("_h")) & (F.col(f"{side}.sub") == F.col("_s"))).drop("_h", "_s")
        finer = child(child(left.where(~few), "p"), "q").select(F.col("_p").alias("p"), F.col("_q").alias("q"))
        finer = checkpointed(_decided(finer, eps))
        new = checkpointed(near.union(named(finer.where("linked"))).distinct())
        found = found.union(new)
        open_ = finer.where("NOT linked").join(new.select(F.col("a").alias("_a"), F.col("b").alias("_b")), (F.col("p.head") == F.col("_a")) & (F.col("q.head") == F.col("_b")), "left_anti")
        left = checkpointed(open_.select("p", "q"))
    return found


def _at(features: list[str]) -> Column:
    """The place of a row, null where a feature is."""
    x = [F.col(f).cast("double") for f in features]
    return F.when(reduce(lambda a, b: a & b, (c.isNotNull() for c in x)), F.array(*x))


def _places(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(id, features, _rows): every place once, with its least key and its number of rows."""
    own = df.dropna(subset=features).select(F.col(key).alias("id"), *(F.col(f).cast("double").alias(f) for f in features))
    return checkpointed(own.groupBy(*features).agg(F.min("id").alias("id"), F.count("*").alias(ROWS)).select("id", *features, ROWS))


def _spread(df: DataFrame, label: DataFrame, features: list[str]) -> DataFrame:
    """`df` with the `cluster` of each row's place; a place of many rows meets them by broadcast."""
    one = label.select(_at(features).alias("_at"), "cluster", F.col(ROWS).alias("_n"))
    total = label.agg(F.sum(ROWS)).first()[0] or 0
    joined = hot_join(df.withColumn("_at", _at(features)), one, "_at", "_n", total, "left")
    return joined.select(*df.columns, F.coalesce("cluster", F.lit(NOISE)).cast(T.LongType()).alias("cluster"))


def dbscan(df: DataFrame, key: str, features: list[str], eps: float, least: int) -> DataFrame:
    """`df` with `cluster`: rows with at least `least` rows within `eps` (themselves included) and what they reach; -1 is noise.

    Equal rows are one place with their number: they have the same neighbours, so the work is over places. `key` is a
    whole number, and rows with a null are noise.
    """
    return _spread(df, _clustered(_places(df, key, features), features, eps, least), features)


def _clustered(rows: DataFrame, features: list[str], eps: float, least: int) -> DataFrame:
    """(id, features, _rows, cluster) of all places.

    Space is cut into cells whose diagonal is `eps`: rows of a cell are all within reach of each other, so a cell with
    `least` rows or more is dense as a whole and no pair of it is compared. Only the places of other cells are compared
    with those of the cells around. Clusters are components of cells; a cluster is numbered by its least core key. A row
    near several clusters goes to the one of its nearest core row. Whether two neighbouring cells are linked is decided
    by `links`, without comparing all of their rows. A place of a cell with fewer than `least` rows is compared with
    those of the cells around, so a place meets at most `least` times as many such places as there are cells around.
    """
    side = eps / math.sqrt(len(features))
    own, rows = rows, rows.withColumn("cell", _cells(features, side))
    reach = math.ceil(math.sqrt(len(features)))
    offsets = F.array(*(F.array(*(F.lit(o).cast("long") for o in offset)) for offset in itertools.product(range(-reach, reach + 1), repeat=len(features))))
    sizes = rows.groupBy("cell").agg(F.sum(ROWS).alias("n"))
    far = lambda p, q: F.sqrt(reduce(lambda a, b: a + b, ((F.col(f"{p}.{f}") - F.col(f"{q}.{f}")) * (F.col(f"{p}.{f}") - F.col(f"{q}.{f}")) for f in features)))

    def around(some: DataFrame, others: DataFrame) -> DataFrame:
        """Pairs (p, q) within reach; each row of `some` visits the cells around its own."""
        visit = some.select(F.struct(*some.columns).alias("p"), F.explode(F.transform(offsets, lambda o: F.zip_with("cell", o, lambda a, b: a + b))).alias("cell"))
        return visit.join(others.select(F.struct(*others.columns).alias("q"), "cell"), "cell").withColumn("d", F.round(far("p", "q"), 9)).where(F.col("d") <= eps)

    sparse = rows.join(sizes.where(F.col("n") < least), "cell")
    counts = around(sparse.drop("n"), rows).groupBy(F.col("p.id").alias("id")).agg(F.sum(f"q.{ROWS}").alias("m"))
    dense = rows.join(sizes.where(F.col("n") >= least).select("cell"), "cell", "left_semi")
    cores = checkpointed(dense.unionByName(rows.join(counts.where(F.col("m") >= least).select("id"), "id", "left_semi")))
    # one core row stands for its cell; cells are linked by any pair of their core rows
    heads = cores.groupBy("cell").agg(F.min("id").alias("head"))
    headed = cores.join(heads, "cell")
    found = components(links(headed, features, eps, side, offsets), heads.select(F.col("head").alias("id")))
    clustered = headed.join(found.withColumnRenamed("id", "head"), "head").select("id", *features, "cell", "component")
    rest = rows.join(cores.select("id"), "id", "left_anti")
    near = around(rest, clustered).groupBy(F.col("p.id").alias("id")).agg(F.min_by(F.col("q.component"), F.struct("d", F.col("q.id"))).alias("component"))
    label = clustered.select("id", "component").unionByName(near)
    return own.join(label, "id", "left").withColumn("cluster", F.coalesce("component", F.lit(NOISE)).cast(T.LongType())).drop("component")


def dbscan_grid(df: DataFrame, key: str, features: list[str], eps: list[float], least: list[int], most_noise: float = MOST_NOISE) -> tuple[DataFrame, DataFrame | None]:
    """(eps, least, clusters, noise, silhouette, note, chosen) of every setting, and `df` with `cluster` of the chosen one, or None.

    The silhouette is over the rows that aren't noise. Settings with fewer than two clusters or more than `most_noise`
    are rejected; of the others the best silhouette is chosen, the first on ties. Noise is a cluster of its own (-1).
    """
    rows = _places(df, key, features)
    whole = df.count()
    lost = whole - (rows.agg(F.sum(ROWS)).first()[0] or 0)  # rows with a null are noise
    made = {}

    def measured(setting: tuple[float, int]) -> tuple:
        e, m = setting
        own = made[setting] = checkpointed(_clustered(rows, features, e, m))
        t = own.agg(F.count_distinct(F.when(F.col("cluster") != NOISE, F.col("cluster"))).alias("clusters"), F.coalesce(F.sum(F.when(F.col("cluster") == NOISE, F.col(ROWS))), F.lit(0)).alias("noise")).first()
        noise = t.noise + lost
        share = noise / whole if whole else 1.0
        found = round(silhouette(own.where(F.col("cluster") != NOISE), features, "cluster"), 6) if t.clusters > 1 else None
        note = "fewer than two clusters" if t.clusters < 2 else "too much noise" if share > most_noise else "noise is a cluster" if noise else "no noise"
        return (e, m, t.clusters, noise, found, note)

    with ThreadPoolExecutor(PARALLEL) as pool:  # a setting is many small jobs
        found = list(pool.map(measured, itertools.product(eps, least)))
    valid = [r for r in found if r[5].startswith("no")]
    best = max(valid, key=lambda r: r[4])[:2] if valid else None
    schema = "eps double, least int, clusters long, noise long, silhouette double, note string, chosen boolean"
    return df.sparkSession.createDataFrame([(*r, r[:2] == best) for r in found], schema), _spread(df, made[best], features) if best else None  # a row for each setting
