"""Synthetic rows of the smaller class, and complexity measures over neighbours of interpolated or minority rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.operators.graph import checkpointed
from equilens.operators.models import interpolations
from equilens.operators.neighbours import knn_join, knn_partitions
from equilens.operators.perturbation import share_of


def _missing(df: DataFrame, label: str) -> tuple[int, int]:
    """The smaller class (of 0 and 1; 1 if equal), and how many rows it lacks."""
    n = df.agg(*(F.count_if(F.col(label) == c) for c in (0, 1))).first()
    return (1 if n[1] <= n[0] else 0), abs(n[0] - n[1])


def _mixed(bases: DataFrame, near: DataFrame, rows: DataFrame, key: str, features: list[str], label: str, small: int) -> DataFrame:
    """For each base and copy one of its neighbours, drawn by a hash, and a point between the two."""
    lists = near.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))), lambda s: s["neighbour"]).alias("_near"))  # k entries
    t = bases.join(lists, key).select(key, *features, "_near", F.explode(F.sequence(F.lit(1), "_copies")).alias("copy"))
    t = t.withColumn("_tag", F.concat_ws("-", key, "copy"))
    t = t.withColumns({"_other": F.element_at("_near", (F.floor(share_of("_tag", "near") * F.size("_near")) + 1).cast("int")), "_a": share_of("_tag", "mix")})
    other = rows.select(F.col(key).alias("_other"), *(F.col(f).alias(f"_{f}") for f in features))
    return t.join(other, "_other").select(F.col(key).alias("base"), "copy", *((F.col(f) + F.col("_a") * (F.col(f"_{f}") - F.col(f))).alias(f) for f in features), F.lit(small).alias(label))


def smote(df: DataFrame, bases: DataFrame, key: str, features: list[str], label: str, k: int = 5) -> DataFrame:
    """(base, copy, features, label): about as many new rows as the smaller class lacks, each between a base and one of its k neighbours of that class.

    Every row of `bases` of the smaller class is a base; they share the new rows evenly, up to a draw by a hash.
    """
    small, lacking = _missing(df, label)
    own, asked = df.where(F.col(label) == small), bases.where(F.col(label) == small)
    each = lacking / max(asked.count(), 1)
    copies = F.floor(F.lit(each)) + (share_of(key, "copies") < each % 1).cast("int")
    asked = asked.withColumn("_copies", copies.cast("int")).where("_copies > 0")
    return _mixed(asked, knn_partitions(asked, own, key, features, k, label), own, key, features, label, small)


def adasyn(df: DataFrame, bases: DataFrame, key: str, features: list[str], label: str, k: int = 5) -> DataFrame:
    """As `smote`, but a base makes new rows in proportion to the share of the other class among its k neighbours of any class, up to a draw by a hash."""
    small, lacking = _missing(df, label)
    own, asked = df.where(F.col(label) == small), bases.where(F.col(label) == small)
    hard = checkpointed(knn_partitions(asked, df, key, features, k, label).groupBy(key).agg(F.avg((F.col("other") != small).cast("int")).alias("_r")))  # the search runs once
    total = hard.agg(F.sum("_r")).first()[0] or 0.0
    hard = hard.withColumn("_each", F.col("_r") / max(total, 1e-12) * lacking)
    copies = (F.floor("_each") + (share_of(key, "copies") < F.col("_each") % 1).cast("int")).cast("int")
    asked = checkpointed(asked.join(hard.withColumn("_copies", copies), key).where("_copies > 0"))
    return _mixed(asked, knn_partitions(asked, own, key, features, k, label), own, key, features, label, small)


def n4(df: DataFrame, key: str, features: list[str], label: str, every: int) -> DataFrame:
    """Error of the nearest row on interpolations of rows of one class, averaged over the classes; asked for every `every`-th key."""
    asked = checkpointed(interpolations(df, key, features, label).where((-F.col(key) - 1) % every == 0))  # counted and searched
    t = knn_join(asked, df, key, features, 1, label).groupBy("own").agg(F.avg((F.col("own") != F.col("other")).cast("int")).alias("e"))
    return t.agg(F.round(F.when(F.count("*") == 2, F.avg("e")), 6).alias("n4"))


def bayes_imbalance(df: DataFrame, asked: DataFrame, key: str, features: list[str], label: str, k: int = 5, depth: int = 100) -> DataFrame:
    """Mean gap of the posterior of the majority with and without balanced classes, over the neighbourhoods of `asked` rows of class 1.

    Where all k neighbours are of class 1, the neighbourhood widens to the first one of class 0 among depth - 1.
    """
    n = df.agg(*(F.count_if(F.col(label) == c) for c in (0, 1))).first()
    depth = min(depth, n[0] + n[1] - 1)
    near = knn_join(asked.where(F.col(label) == 1), df, key, features, max(depth - 1, 1), label)
    per = near.groupBy(key).agg(F.count_if((F.col("rank") <= k) & (F.col("other") == 1)).alias("m"), F.min(F.when(F.col("other") == 0, F.col("rank"))).alias("r"))
    k = min(k, max(depth - 1, 1))
    m = F.when(F.col("m") == k, F.coalesce(F.col("r") - 2, F.lit(depth))).otherwise(F.col("m"))
    size = F.when(F.col("m") == k, m + 1).otherwise(F.lit(k))
    own, other = m / size, (size - m) / size
    scaled = other * (n[0] / max(n[1], 1))
    gap = scaled / (scaled + own + 1e-12) - other / (other + own + 1e-12)
    return per.agg(F.round(F.avg(gap), 6).alias("bayes"))
