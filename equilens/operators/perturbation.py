"""Controlled damage to tables: missing values and repeated rows, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share_of(key: str, salt: str) -> Column:
    """A number in [0, 1) for a key, from the first 28 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), F.col(key).cast("string"))), 1, 7), 16, 10).cast("double") / 2**28


def order_of(key: str, salt: str) -> Column:
    """As `share_of`, from 52 bits: an order in which ties are hardly ever met."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), F.col(key).cast("string"))), 1, 13), 16, 10).cast("double") / 2**52


def inject_missing_mcar(df: DataFrame, key: str, column: str, p: float) -> DataFrame:
    return df.withColumn(column, F.when(share_of(key, column) >= p, F.col(column)))


def inject_missing_mar(df: DataFrame, key: str, column: str, by: str, weights: dict[str, float], p: float) -> DataFrame:
    """Nulls with a chance in proportion to the weight of another column's category (1 if not listed), `p` on average, at most 1."""
    weight = F.lit(1.0)
    for value, w in weights.items():
        weight = F.when(F.col(by) == value, w).otherwise(weight)
    mean = df.agg(F.avg(weight).alias("_mean"))  # one row
    t = df.crossJoin(F.broadcast(mean))
    return t.withColumn(column, F.when(share_of(key, column) >= F.least(F.lit(1.0), p * weight / F.col("_mean")), F.col(column))).drop("_mean")


def inject_duplicates(df: DataFrame, key: str, p: float) -> DataFrame:
    """`df` with a second copy of about a share `p` of its rows."""
    return df.withColumn("_n", F.when(share_of(key, "copy") < p, 2).otherwise(1)).select(*df.columns, F.explode(F.sequence(F.lit(1), "_n")).alias("copy_no"))


def join_truth(profile: DataFrame, truth: dict[str, str], observed: str) -> DataFrame:
    """(column, expected, observed, hit) of the columns whose type is known."""
    listed = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("expected")) for c, t in truth.items()))
    known = profile.sparkSession.range(1).select(F.inline(listed))
    t = known.join(profile.select("column", F.col(observed).alias("observed")), "column", "left")
    return t.withColumn("hit", F.col("expected").eqNullSafe(F.col("observed")))


def score_profiler(joined: dict[float, DataFrame]) -> DataFrame:
    """(knob, columns, accuracy): how well types are told at each strength of the damage."""
    parts = [df.agg(F.lit(float(k)).alias("knob"), F.count("*").alias("columns"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("accuracy")) for k, df in joined.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def type_confusion(joined: DataFrame) -> DataFrame:
    """(expected, observed, n): how often each type is taken for each other."""
    return joined.groupBy("expected", "observed").agg(F.count("*").alias("n"))
