"""Thresholds by group that meet a constraint, fitted after training on saved scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equilens.operators.statistics import SLICE, running

#: What the groups have in common: share selected, of the positives selected, of the negatives selected.
CONSTRAINTS = ("demographic_parity", "true_positive_rate", "false_positive_rate")
#: The constraint that takes two rates at once, and so the hull of a group's curve.
BOTH_RATES = "equalized_odds"
GRID = 100
#: Pieces of a hull that one task merges.
MERGED = 32


def curve(df: DataFrame, group: str, label: str, score: str, slice_rows: int = SLICE) -> DataFrame:
    """(grp, s, upper, p, q, tp1, fp1, pn, qn): a group's distinct scores from the highest, with the positives and negatives from there on.

    `upper` is the next higher score. Rows with a null are left out, and groups with one class only. Sums run in ranges
    of the scores (`statistics.running`), so that no group meets in one task.
    """
    t = df.dropna(subset=[group, label, score]).groupBy(F.col(group).alias("grp"), F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    t = t.withColumn("_down", -F.col("s").cast("double"))
    whole = t.groupBy("grp").agg(F.sum("p").alias("pn"), F.sum("q").alias("qn")).where("pn > 0 AND qn > 0")
    run = running(t, ["grp"], "_down", {"p": "tp1", "q": "fp1"}, slice_rows, "_above").withColumn("upper", (-F.col("_above")).cast(df.schema[score].dataType))
    return run.join(F.broadcast(whole), "grp").drop("_down", "_above")  # a row for each group


def _on_grid(t: DataFrame, low: Column, high: Column, last: Column) -> DataFrame:
    """`t` with `g` and `mix`: the values of the grid from `low` on and before `high` (where `last` holds, with it), each a row."""
    t = t.withColumns({"x0": low * GRID, "x1": high * GRID, "_last": last}).where("x1 > x0")
    grid = F.sequence(F.ceil("x0").cast("int"), F.ceil("x1").cast("int"))
    t = t.withColumn("g", F.explode(F.filter(grid, lambda g: (g < F.col("x1")) | ((g == F.col("x1")) & F.col("_last")))))
    return t.withColumn("mix", (F.col("g") - F.col("x0")) / (F.col("x1") - F.col("x0"))).drop("_last")


def fit_thresholds(df: DataFrame, group: str, label: str, score: str, constraint: str = "demographic_parity", slice_rows: int = SLICE) -> DataFrame:
    """(group, rate, upper, lower, mix): rows from `upper` on are selected, those from `lower` on with the chance `mix`.

    `rate` is the value of a grid, the same in all groups, with the best balanced accuracy (ties: the least). The
    curves are running counts of a group's distinct scores; between two points they are mixed. `upper` is null where
    no row is selected for sure. Rows with a null are left out, and groups with one class only. For equalized odds see
    `fit_equalized_odds`, whose rows have the further columns `tpr` and `ignore`.
    """
    if constraint == BOTH_RATES:
        return fit_equalized_odds(df, group, label, score, slice_rows)
    t = curve(df, group, label, score, slice_rows).withColumns({"tp0": F.col("tp1") - F.col("p"), "fp0": F.col("fp1") - F.col("q")})
    rate = {"demographic_parity": lambda k: (F.col(f"tp{k}") + F.col(f"fp{k}")) / (F.col("pn") + F.col("qn")), "true_positive_rate": lambda k: F.col(f"tp{k}") / F.col("pn"), "false_positive_rate": lambda k: F.col(f"fp{k}") / F.col("qn")}[constraint]
    t = _on_grid(t, rate(0), rate(1), F.col("x1") == GRID)
    t = t.withColumns({"tp": F.col("tp0") + F.col("mix") * F.col("p"), "fp": F.col("fp0") + F.col("mix") * F.col("q")})
    over = t.groupBy("g").agg(F.round(F.sum("tp") / F.sum("pn") - F.sum("fp") / F.sum("qn"), 9).alias("gain"))
    best = over.agg(F.max_by("g", F.struct("gain", -F.col("g"))).alias("g"))  # one row
    return t.join(F.broadcast(best), "g").select(F.col("grp").alias(group), (F.col("g") / GRID).alias("rate"), "upper", F.col("s").alias("lower"), F.round("mix", 6).alias("mix"))


def chain(points: list[tuple]) -> list[tuple]:
    """The upper hull of points (x, y, ...) of whole numbers, from left to right, by a monotone chain; of equal x the largest y stays."""
    kept: list[tuple] = []
    for p in sorted(points, key=lambda p: (p[0], -p[1])):
        if kept and kept[-1][0] == p[0]:
            continue
        while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1]) >= (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0]):
            kept.pop()
        kept.append(p)
    return kept


def roc_hull(df: DataFrame, group: str, label: str, score: str, slice_rows: int = SLICE) -> DataFrame:
    """(grp, x, y, s, pn, qn): vertices of the upper hull of each group's ROC curve, x negatives and y positives from the score `s` on.

    The first vertex selects no row and has no score, unless the best scores are all positives. A curve is cut into
    pieces along itself. Each piece's hull is taken in a task of its own, and the hulls of MERGED neighbouring pieces
    are merged in the next round: what is no vertex of a piece is none of the whole, so a task holds one piece, or the
    vertices of MERGED pieces.
    """
    points = curve(df, group, label, score, slice_rows)
    kind = df.schema[score].dataType
    none = points.select("grp", "pn", "qn").distinct().select("grp", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(None).cast(kind).alias("s"), "pn", "qn")
    all_ = points.select("grp", F.col("fp1").alias("x"), F.col("tp1").alias("y"), "s", "pn", "qn").unionByName(none)
    most = max(1, all_.agg(F.max(F.col("pn") + F.col("qn"))).first()[0] or 1)
    pieces = -(-most // slice_rows)  # rows bound the distinct scores of a piece
    t = all_.withColumn("piece", F.floor((F.col("x") + F.col("y")) / (F.col("pn") + F.col("qn") + 1) * F.lit(pieces)).cast("long"))
    schema = t.schema

    def hull(part: pd.DataFrame) -> pd.DataFrame:
        kept = chain(list(zip(part["x"].tolist(), part["y"].tolist(), range(len(part)))))
        return part.iloc[[k for _, _, k in kept]]

    while True:
        t = t.groupBy("grp", "piece").applyInPandas(hull, schema)
        if pieces == 1:
            return t.drop("piece")
        pieces = -(-pieces // MERGED)
        t = t.withColumn("piece", F.floor(F.col("piece") / MERGED).cast("long"))


def fit_equalized_odds(df: DataFrame, group: str, label: str, score: str, slice_rows: int = SLICE) -> DataFrame:
    """(group, rate, tpr, upper, lower, mix, ignore): the same rates of false and true positives in all groups.

    `rate` is the false positive rate, a value of a grid. What all groups can reach there is the least of their hulls;
    the best balanced accuracy wins (ties: the least rate). A group whose hull lies above is brought down: with the
    chance `ignore` a row's score is ignored and the row is selected with the chance `rate`. Else as `fit_thresholds`.
    """
    w = Window.partitionBy("grp").orderBy("x")  # the vertices of one hull
    nexts = {"xn": F.lead("x").over(w), "yn": F.lead("y").over(w), "lower": F.lead("s").over(w)}
    t = roc_hull(df, group, label, score, slice_rows).withColumns(nexts).where("xn IS NOT NULL")
    t = _on_grid(t, F.col("x") / F.col("qn"), F.col("xn") / F.col("qn"), F.col("xn") == F.col("qn"))
    t = t.withColumn("own", (F.col("y") + F.col("mix") * (F.col("yn") - F.col("y"))) / F.col("pn"))
    over = t.groupBy("g").agg(F.min("own").alias("tpr"))
    best = over.orderBy(F.desc(F.round(F.col("tpr") - F.col("g") / GRID, 9)), "g").limit(1)  # of a row for each value of the grid
    t = t.join(F.broadcast(best), "g").withColumn("rate", F.col("g") / GRID)
    above = F.col("own") - F.col("rate")
    ignore = F.when(above > 0, F.round((F.col("own") - F.col("tpr")) / above, 6)).otherwise(0.0)
    return t.select(F.col("grp").alias(group), "rate", F.round("tpr", 6).alias("tpr"), F.col("s").alias("upper"), "lower", F.round("mix", 6).alias("mix"), ignore.alias("ignore"))


def apply_thresholds(df: DataFrame, thresholds: DataFrame, group: str, score: str, key: str) -> DataFrame:
    """`df` with y_pred; chances are drawn by hashes of `key`. A group without thresholds keeps its y_pred (else null)."""
    kept = [c for c in df.columns if c != "y_pred"]
    had = F.col("y_pred") if "y_pred" in df.columns else F.lit(None).cast("int")
    own = [c for c in ("upper", "lower", "mix", "rate", "ignore") if c in thresholds.columns]
    t = df.join(F.broadcast(thresholds.select(group, *(F.col(c).alias(f"_{c}") for c in own))), group, "left")  # a row for each group
    draw = lambda *salt: F.pmod(F.xxhash64(key, *map(F.lit, salt)), F.lit(1_000_000)) / 1_000_000
    picked = F.coalesce(F.col(score) >= F.col("_upper"), F.lit(False)) | ((F.col(score) >= F.col("_lower")) & (draw() < F.col("_mix")))
    if "ignore" in own:
        picked = F.when(draw("ignore") < F.col("_ignore"), draw("rate") < F.col("_rate")).otherwise(picked)
    return t.select(*kept, F.when(F.col("_lower").isNull(), had).otherwise(picked.cast("int")).alias("y_pred"))
