"""Natural breaks (Fisher and Jenks), exact, of groups of any size."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equilens.operators.graph import checkpointed, deleted, hot_join, shared_folder
from equilens.operators.statistics import SLICE, running

#: Distinct values of one block: what a task holds of a group, twice.
BLOCK = 20_000
#: Blocks whose ends are found between two known ones in one round.
FAN = 32
#: A node is a number of values from a group's least on, with the sums of their counts, values and squares.
NODE = ["i", "w", "s", "q"]


def last_cuts(to: np.ndarray, at: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node of `to`, the least spread of its values with a last cut at a node of `at`, and the place of that in `at`.

    Both are columns of NODE in rising order; `best` is the spread up to each node of `at`, and a cut lies before its
    node. The best cut never moves back as values are added, so all are found by divide and conquer. A node of `to`
    without one of `at` before it has an infinite spread.
    """
    (i, w, s, q), (ci, cw, cs, cq) = to.T, at.T
    ends = np.searchsorted(ci, i)
    least, cut = np.full(len(to), np.inf), np.zeros(len(to), int)
    todo = [(int(np.searchsorted(ends, 0, side="right")), len(to) - 1, 0, len(at) - 1)]
    while todo:
        first, last, low, high = todo.pop()
        if first > last:
            continue
        j = (first + last) // 2
        c = slice(low, min(high + 1, ends[j]))
        total = best[c] + (q[j] - cq[c]) - (s[j] - cs[c]) ** 2 / (w[j] - cw[c])
        k = int(total.argmin())
        least[j], cut[j] = total[k], low + k
        todo += [(first, j - 1, low, low + k), (j + 1, last, low + k, high)]
    return least, cut


def natural_breaks(v: np.ndarray, n: np.ndarray, classes: int) -> list[float]:
    """The least value and the largest of each class of the sorted values v, with counts n, that differ least from their means."""
    m, c = len(v), v - np.average(v, weights=n)
    nodes = np.column_stack([np.arange(m + 1), *(np.concatenate([[0], np.cumsum(x)]) for x in (n, n * c, n * c * c))])
    best, cuts = np.concatenate([[0], np.full(m, np.inf)]), []
    for x in range(1, min(classes, m) + 1):
        least, cut = last_cuts(nodes[x:], nodes[x - 1 : m], best[x - 1 : m])
        best = np.concatenate([np.full(x, np.inf), least])
        cuts.append(np.concatenate([np.zeros(x, int), cut + x - 1]))
    edges, j = [v[-1]], m
    for cut in reversed(cuts):
        j = cut[j]
        edges.append(v[j - 1] if j else v[0])
    return [float(e) for e in reversed(edges)]


def _kept(df: DataFrame, folder: str) -> DataFrame:
    """`df` as a table below the folder. A checkpoint would keep what the optimizer inferred of its columns, more in every round."""
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _cuts(points: DataFrame, level: DataFrame, on: list[str], first: int) -> DataFrame:
    """(_g, b, NODE, m, best, cut) of `points`: the best of the last cuts that each meets in the blocks of `level` with the same `on`.

    Candidates are nodes from `first` on. A block's answers are rows, of which the least for each point counts.
    """

    def met(points: pd.DataFrame, level: pd.DataFrame) -> pd.DataFrame:
        points, level = points.sort_values("i"), level[level["i"] >= first].sort_values("i")
        least, cut = np.full(len(points), np.inf), np.zeros(len(points), int)
        if len(points) and len(level):
            least, cut = last_cuts(points[NODE].to_numpy(float), level[NODE].to_numpy(float), level["best"].to_numpy())
            cut = level["i"].to_numpy()[cut]
        out = points[["_g", "own", *NODE, "m"]].assign(best=least, cut=cut)
        return out[np.isfinite(least)]

    points, level = (t.toDF(*t.columns) for t in (points, level))  # both may come from one table
    found = points.groupBy(*on).cogroup(level.groupBy(*on)).applyInPandas(met, "_g long, own long, i long, w double, s double, q double, m long, best double, cut long")
    t = found.groupBy("_g", "own", "i").agg(F.min(F.struct("best", "cut", "w", "s", "q", "m")).alias("x"))
    return t.select("_g", F.col("own").alias("b"), "i", "x.w", "x.s", "x.q", "x.m", "x.best", "x.cut")


def _blocks(low, high, block: int):
    """A row for each block between two nodes."""
    return F.explode(F.sequence(F.floor(low / block), F.floor(high / block)))


def _next_level(level: DataFrame, x: int, block: int, fan: int, most: int, folder: str) -> DataFrame:
    """From the best divisions of all nodes into x - 1 classes, those into x.

    First the last nodes of blocks: with cuts known for some, the ones between them look for theirs between those,
    `fan` at a time. Then each block meets the blocks between the cuts of its ends: about twice as many pairs as blocks.
    Of a group one task sees the ends of blocks at most, or two blocks.
    """
    stops = _kept(level.where((F.col("i") % block == block - 1) | (F.col("i") == F.col("m"))).select("_g", "b", *NODE, "m"), folder)
    by_place = Window.partitionBy("_g").orderBy("b")
    before, after = by_place.rowsBetween(Window.unboundedPreceding, -1), by_place.rowsBetween(1, Window.unboundedFollowing)
    known = stops.withColumn("cut", F.lit(None).cast("long"))
    span = lambda t: t.withColumns({"low": F.coalesce(F.max("cut").over(before), F.lit(x - 1)), "high": F.coalesce("cut", F.min("cut").over(after), F.col("i") - 1)})
    step = 1
    while step * fan < most:
        step *= fan
    while step:
        asked = span(known).where(F.col("cut").isNull() & (((F.col("b") + 1) % step == 0) | (F.col("i") == F.col("m"))) & (F.col("low") <= F.col("high")))
        asked = asked.select("_g", F.col("b").alias("own"), *NODE, "m", _blocks(F.col("low"), F.col("high"), block).alias("b"))
        new = _cuts(asked, level, ["_g", "b"], x - 1).select("_g", "b", F.col("cut").alias("_new"))
        known = _kept(known.join(new, ["_g", "b"], "left").withColumn("cut", F.coalesce("cut", "_new")).drop("_new"), folder)
        step //= fan
    pairs = _kept(span(known).where("low <= high").select("_g", F.col("b").alias("own"), _blocks(F.col("low"), F.col("high"), block).alias("b")), folder)
    targets = level.where(F.col("i") >= x).withColumnRenamed("b", "own").join(pairs, ["_g", "own"]).select("_g", "own", "b", *NODE, "m")
    candidates = level.where(F.col("i") >= x - 1).join(pairs, ["_g", "b"]).select("_g", "own", "b", *NODE, "best")
    return _cuts(targets, candidates, ["_g", "own", "b"], x - 1)


def _breaks_by_blocks(rows: DataFrame, classes: int, block: int, fan: int, slice_rows: int, most: int) -> DataFrame:
    """(_g, edges) of groups with more than `block` distinct values, from rows (_g, value, n, m, mean)."""
    c = F.col("value") - F.col("mean")
    t = rows.select("_g", "value", "m", F.col("n").cast("double").alias("_w"), (F.col("n") * c).alias("_s"), (F.col("n") * c * c).alias("_q"), F.lit(1).alias("_i"))
    t = running(t, ["_g"], "value", {"_w": "w", "_s": "s", "_q": "q", "_i": "i"}, slice_rows)
    folder = shared_folder(rows.sparkSession, "breaks")
    nodes = _kept(t.select("_g", F.floor(F.col("i") / block).alias("b"), "i", "w", "s", "q", "m", "value"), folder)
    levels = [nodes.select("_g", "b", *NODE, "m", (F.col("q") - F.col("s") ** 2 / F.col("w")).alias("best"))]
    for x in range(2, classes):
        levels.append(_kept(_next_level(levels[-1], x, block, fan, most // block + 1, folder), folder))
    end = levels[-1].where("i = m").select("_g", F.lit(-1).cast("long").alias("own"), *NODE, "m", _blocks(F.lit(0), F.col("m") - 1, block).alias("b"))
    path = [_cuts(end, levels[-1], ["_g", "b"], classes - 1).select("_g", F.col("cut").alias("i"))] if classes > 1 else []
    for level in reversed(levels[1:]):
        path[-1] = _kept(path[-1], folder)
        path.append(level.join(path[-1], ["_g", "i"]).select("_g", F.col("cut").alias("i")))
    ends = nodes.groupBy("_g").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    inner = nodes.limit(0).select("_g", "value")
    for p in path:
        inner = inner.union(nodes.join(p, ["_g", "i"]).select("_g", "value"))
    inner = inner.groupBy("_g").agg(F.sort_array(F.collect_set("value")).alias("inner"))  # a value for each class but one
    t = ends.join(inner, "_g", "left")
    found = checkpointed(t.select("_g", F.concat(F.array(F.col("low") - 0.001), F.coalesce("inner", F.array().cast("array<double>")), F.array(F.col("high") + 0.001)).alias("edges")))
    deleted(rows.sparkSession, folder)
    return found


def jenks_edges(df: DataFrame, keys: list[str], column: str, n: int, block: int = BLOCK, fan: int = FAN, slice_rows: int = SLICE) -> DataFrame:
    """(keys, edges): natural breaks of each group over its distinct values and their counts; null and values that aren't finite don't count.

    The first and last edge are the group's extremes, widened by 0.001. A group of fewer than `n` distinct values has
    as many bins as values. A group of at most `block` values is one task; larger ones are divided into blocks,
    which meet in pairs (see `_next_level`), so that no task holds a group: the same divisions, but for rounding.
    """
    if n < 1 or fan < 2:
        raise ValueError("at least one class, and a fan of two or more")
    block = max(block, n)
    value = F.col(column).cast("double")
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_"))
    counts = checkpointed(df.where(F.abs(value) < float("inf")).groupBy(key.alias("_key"), value.alias("value")).agg(F.count("*").alias("n")))
    sizes = counts.groupBy("_key").agg(F.count("*").alias("m"), (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"))
    sizes = checkpointed(sizes.withColumn("_g", F.monotonically_increasing_id()))
    total, most = sizes.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.max("m"), F.lit(0))).first()
    rows = hot_join(counts, sizes, "_key", "m", total).drop("_key")

    def breaks(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("value")
        edges = natural_breaks(part["value"].to_numpy(), part["n"].to_numpy(float), n)
        inner = sorted(set(edges[1:-1]) - {edges[-1]})
        return pd.DataFrame({"_g": [part["_g"].iloc[0]], "edges": [[edges[0] - 0.001, *inner, edges[-1] + 0.001]]})

    found = rows.where(F.col("m") <= block).select("_g", "value", "n").groupBy("_g").applyInPandas(breaks, "_g long, edges array<double>")
    if most > block:
        found = found.unionByName(_breaks_by_blocks(rows.where(F.col("m") > block), n, block, fan, slice_rows, most))
    return found.join(sizes, "_g").select(*(F.col("_key")[k].alias(k) for k in keys), "edges")
