"""Binning of numeric attributes: edges, application, repair, and what the bins do to rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equilens.operators.statistics import quantiles


def bin_index(value: Column, edges: list[float]) -> Column:
    """Ordinal of the right-closed interval, the lowest edge included; null outside."""
    out = F.when((value >= edges[0]) & (value <= edges[1]), F.lit(0))
    for i in range(1, len(edges) - 1):
        out = out.when((value > edges[i]) & (value <= edges[i + 1]), F.lit(i))
    return out


def bin_apply(df: DataFrame, column: str, edges: list[float], labels: list[str] | None = None, out: str = "bin") -> DataFrame:
    index = bin_index(F.col(column), edges)
    return df.withColumn(out, F.get(F.array(*map(F.lit, labels)), index) if labels else index)


def quantile_edges(df: DataFrame, column: str, n: int) -> list[float]:
    """Exact quantiles; equal edges are merged."""
    q = quantiles(df, [], column, [i / n for i in range(n + 1)]).first()
    return sorted(set(q[0])) if q and q[0][0] is not None else []


def equal_width_edges(df: DataFrame, column: str, n: int) -> list[float]:
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None or lo == hi:
        raise ValueError(f"{column} is constant")
    step = (hi - lo) / n
    return [lo - 0.001, *(lo + step * i for i in range(1, n)), hi + 0.001]


def identity_edges(df: DataFrame, column: str, most: int) -> list[float]:
    """One bin for each distinct value, cut at the midpoints."""
    values = [r[0] for r in df.select(F.col(column).cast("double")).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values")
    return [values[0] - 0.5, *((a + b) / 2 for a, b in zip(values, values[1:])), values[-1] + 0.5]


def bin_repair(df: DataFrame, column: str, edges: list[float], least: int) -> list[float]:
    """Merges the smallest bin below `least` rows into its smaller neighbour (the right one on a tie) until none is left.

    The outer edges are clipped to the range of the data first. The rows are counted once; only the counts are merged.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is not None:
        edges = [max(edges[0], low), *(e for e in edges[1:-1] if low < e < high), min(edges[-1], high)]
    index = bin_index(F.col(column), edges)
    found = {r["b"]: r["count"] for r in df.groupBy(index.alias("b")).count().where("b IS NOT NULL").collect()}
    counts, edges = [found.get(i, 0) for i in range(len(edges) - 1)], list(edges)
    while counts and not counts[0] and len(counts) > 1:
        counts.pop(0), edges.pop(0)
    while counts and not counts[-1] and len(counts) > 1:
        counts.pop(), edges.pop()
    while len(counts) > 1 and min(counts) < least:
        i = counts.index(min(counts))
        right = i + 1 < len(counts) and (i == 0 or counts[i + 1] <= counts[i - 1])
        j = i if right else i - 1
        counts[j : j + 2] = [counts[j] + counts[j + 1]]
        edges.pop(j + 1)
    return edges


def bin_stats(df: DataFrame, column: str, target: str, by: str = "bin") -> DataFrame:
    total = df.count()
    t = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(target), 6).alias("rate"), F.min(column).alias("low"), F.max(column).alias("high"))
    return t.withColumn("share", F.round(F.col("n") / max(total, 1), 6))


def bin_fairness(df: DataFrame, target: str, by: str = "bin") -> DataFrame:
    """Sizes, their variation, the gap and ratio of rates, and the largest deviation from the overall rate."""
    rows = df.where(F.col(by).isNotNull())
    t = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(target).alias("pos")).withColumn("rate", F.col("pos") / F.col("n"))
    u = t.withColumn("overall", F.sum("pos").over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy()))  # a row for each bin
    r = F.round
    return u.agg(
        F.count("*").alias("bins"), F.min("n").alias("least"), F.max("n").alias("most"), r(F.stddev_samp("n") / F.avg("n"), 6).alias("cv"),
        r(F.max("rate") - F.min("rate"), 6).alias("gap"), r(F.when(F.max("rate") > 0, F.min("rate") / F.max("rate")), 6).alias("dp_ratio"), r(F.max(F.abs(F.col("rate") - F.col("overall"))), 6).alias("max_deviation"),
    )


def bin_disparity(df: DataFrame, target: str, by: str = "bin") -> DataFrame:
    t = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.avg(target).alias("rate"))
    d = t.agg(F.max("rate").alias("hi"), F.min("rate").alias("lo"), F.max_by(by, F.struct("rate", by)).alias("highest"), F.min_by(by, F.struct("rate", by)).alias("lowest"))
    ratio = F.when(F.col("lo") > 0, F.col("hi") / F.col("lo"))
    return d.select("highest", "lowest", F.round("hi", 6).alias("hi"), F.round("lo", 6).alias("lo"), F.round(ratio, 6).alias("ratio"), F.when(ratio >= 3, "P0").when(ratio >= 1.5, "P1").alias("priority"))


def bin_sensitive_mix(df: DataFrame, attr: str, by: str = "bin") -> DataFrame:
    t = df.where(F.col(by).isNotNull()).groupBy(by, F.col(attr).alias("value")).agg(F.count("*").alias("n"))
    return t.select(by, "value", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(by)), 4).alias("pct"))


def bin_ordinal(df: DataFrame, column: str, by: str = "bin") -> DataFrame:
    t = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.avg(column).alias("mean"))
    return t.select(by, F.dense_rank().over(Window.partitionBy().orderBy("mean")).alias("ordinal"))


def bin_compare(df: DataFrame, column: str, target: str, strategies: dict[str, list[float]]) -> DataFrame:
    """Score of each strategy: a third each for size, evenness and equal rates. Rows are read once for all strategies."""
    each = F.array(*(F.struct(F.lit(n).alias("strategy"), bin_index(F.col(column), e).alias("bin")) for n, e in strategies.items()))
    t = df.select(F.col(target).alias("t"), F.inline(each)).where("bin IS NOT NULL").groupBy("strategy", "bin").agg(F.count("*").alias("n"), F.avg("t").alias("rate"))
    s = t.groupBy("strategy").agg(F.count("*").alias("bins"), (F.min("n") / F.avg("n")).alias("a"), F.coalesce(F.stddev_samp("n") / F.avg("n"), F.lit(0.0)).alias("cv"), (F.max("rate") - F.min("rate")).alias("gap"))
    zero = F.lit(0.0)
    score = (F.col("a") + F.greatest(zero, 1 - F.col("cv")) + F.greatest(zero, 1 - F.col("gap") / 0.5)) / 3
    return s.select("strategy", "bins", F.round("cv", 6).alias("cv"), F.round("gap", 6).alias("gap"), F.round(score, 6).alias("score"))
