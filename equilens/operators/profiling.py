"""Dataset profiles: missing values, duplicates, distributions, balance and column types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equilens.operators.statistics import quantiles


def missing_by_column(df: DataFrame) -> DataFrame:
    """Nulls of every column, all counted in one aggregation."""
    row = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(c).isNull()).alias(f"{c}__missing") for c in df.columns))
    listed = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}__missing").alias("missing")) for c in df.columns))
    return row.select("_n", F.inline(listed)).select("column", "missing", F.round(F.when(F.col("_n") > 0, F.col("missing") / F.col("_n")).otherwise(0.0), 6).alias("share"))


def missing_by_group(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    t = df.groupBy(F.col(group).alias("grp")).agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return t.select("grp", F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns))))


def missing_rows(df: DataFrame) -> DataFrame:
    some = F.exists(F.array(*(F.col(c).isNull() for c in df.columns)), lambda x: x)
    t = df.agg(F.count("*").alias("n"), F.count_if(some).alias("incomplete"))
    share = F.when(F.col("n") > 0, F.col("incomplete") / F.col("n")).otherwise(0.0)
    return t.select("n", "incomplete", (F.col("n") - F.col("incomplete")).alias("complete"), F.when(share < 0.05, "drop_rows").when(share < 0.5, "impute").otherwise("drop_column").alias("action"))


def missing_cooccurrence(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    t = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(a).isNull() & F.col(b).isNull()).alias(f"{a}__{b}") for a, b in pairs))
    return t.select("_n", F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("both")) for a, b in pairs)))).select("a", "b", "both", F.round(F.col("both") / F.greatest("_n", F.lit(1)), 6).alias("share"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows; nulls are equal."""
    t = df.groupBy(*df.columns).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))
    return t.select("n", "duplicates", F.round(F.when(F.col("n") > 0, F.col("duplicates") / F.col("n")).otherwise(0.0), 4).alias("share"))


def duplicate_index_values(df: DataFrame, columns: list[str]) -> DataFrame:
    t = value_counts(df.select(*columns)).where("value IS NOT NULL").groupBy("column").agg(F.sum(F.col("n") - 1).alias("repeated"), F.count("*").alias("distinct"))
    return t.select("column", "repeated", "distinct")


def sensitive_distribution(df: DataFrame, attrs: list[str]) -> DataFrame:
    """Rows and share of each group; shares are of all rows, null ones included."""
    n = df.count()
    pairs = F.array(*(F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("grp")) for a in attrs))
    return df.select(F.inline(pairs)).where("grp IS NOT NULL").groupBy("attr", "grp").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / max(n, 1), 6))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Rows of each class (null is one), the ratio of the largest to the smallest, and a label for it."""
    t = df.groupBy(F.coalesce(F.col(target).cast("string"), F.lit("missing")).alias("class")).agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    r = F.max("n").over(w) / F.min("n").over(w)  # a row for each class, not for each row
    return t.select("class", "n", F.round(r, 6).alias("ratio"), F.when(r < 1.5, "balanced").when(r < 3, "mild").otherwise("high").alias("label"))


def group_statistics(df: DataFrame, attr: str, target: str) -> DataFrame:
    n = df.count()
    return df.where(F.col(attr).isNotNull()).groupBy(F.col(attr).alias("grp")).agg(F.count("*").alias("n"), F.round(F.avg(target), 6).alias("prevalence"), F.count_if(F.col(target) == 1).alias("positives"), F.count_if(F.col(target) == 0).alias("negatives")).withColumn("share", F.round(F.col("n") / max(n, 1), 6))


def target_rate_by_group(df: DataFrame, attr: str, target: str) -> DataFrame:
    """(grp, n, rate): the mean target of each group; rows without a group are the null group, and a null target counts in n alone."""
    return df.groupBy(F.col(attr).alias("grp")).agg(F.count("*").alias("n"), F.round(F.avg(target), 6).alias("rate"))


def representation_balance(df: DataFrame, attrs: list[str]) -> DataFrame:
    t = sensitive_distribution(df, attrs).groupBy("attr").agg(F.count("*").alias("groups"), F.min("n").alias("least"), F.max("n").alias("most"), F.stddev_samp("n").alias("sd"), F.avg("n").alias("mean"))
    return t.select("attr", "groups", "least", "most", F.round(F.col("most") / F.col("least"), 6).alias("size_ratio"), F.round(F.col("sd") / F.col("mean"), 6).alias("cv"))


def label_imbalance(df: DataFrame, attrs: list[str], target: str) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("grp")) for a in attrs))
    t = df.select(target, F.inline(pairs)).where("grp IS NOT NULL").groupBy("attr", "grp").agg(F.avg(target).alias("rate")).groupBy("attr").agg(F.max("rate").alias("hi"), F.min("rate").alias("lo"))
    return t.select("attr", F.round(F.col("hi") - F.col("lo"), 6).alias("max_difference"), F.round(F.when(F.col("lo") > 0, F.col("hi") / F.col("lo")), 6).alias("max_ratio"))


def value_counts(df: DataFrame) -> DataFrame:
    """(column, value, n): how often each value of each column occurs, null being one; counted where the rows are first."""
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns))
    return df.select(F.inline(each)).groupBy("column", "value").agg(F.count("*").alias("n"))


def column_profile(df: DataFrame) -> DataFrame:
    """Distinct and missing values of every column, by one grouping of (column, value)."""
    kinds = F.create_map(*(F.lit(x) for c, t in df.dtypes for x in (c, kind_of(t))))
    known = F.col("value").isNotNull()
    t = value_counts(df).groupBy("column").agg(F.count_if(known).alias("n_unique"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("present"), F.sum("n").alias("_n"))
    ratio = F.round(F.when(F.col("present") > 0, F.col("n_unique") / F.col("present")).otherwise(0.0), 6)
    return t.select("column", kinds[F.col("column")].alias("kind"), "n_unique", "present", (F.col("_n") - F.col("present")).alias("n_missing"), ratio.alias("distinct_ratio"), (F.col("n_unique") == F.col("_n")).alias("all_unique"))


def kind_of(dtype: str) -> str:
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        return "integer"
    if dtype in ("float", "double") or dtype.startswith("decimal"):
        return "float"
    return "datetime" if dtype in ("date", "timestamp", "timestamp_ntz") else "string"


#: Parts of a name that hint at an identifier.
ID_HINTS = ("id", "key", "uuid", "index")


def semantic_type(profile: DataFrame) -> DataFrame:
    """identifier, datetime, binary, categorical, continuous or text, from a column profile."""
    hint = F.lower("column").rlike(rf"(^|_)({'|'.join(ID_HINTS)})$|key$|_id$")
    numeric = F.col("kind").isin("integer", "float")
    t = (
        F.when((F.col("distinct_ratio") >= 0.98) & hint, "identifier").when(F.col("kind") == "datetime", "datetime").when(F.col("n_unique") == 2, "binary")
        .when(numeric & ((F.col("n_unique") <= 12) | (F.col("distinct_ratio") < 0.05)), "categorical").when(numeric, "continuous").when(F.col("n_unique") <= 20, "categorical").otherwise("text")
    )
    return profile.select("column", "n_unique", t.alias("semantic_type"))


def numeric_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum, exact quartiles, maximum, mean and standard deviation (of the population)."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns)))).where("v IS NOT NULL")
    q = long.groupBy("column").agg(F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    q = q.join(quantiles(long, ["column"], "v", [0.25, 0.5, 0.75]), "column")
    return q.select("column", "n", "min", *(F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("q1", "median", "q3"))), "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    v = F.col(column).cast("double")
    at = F.least(F.floor((v - lo) / ((hi - lo) / bins)), F.lit(bins - 1)) if lo is not None and hi > lo else F.lit(0)
    return df.where(F.col(column).isNotNull()).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def categorical_distribution(df: DataFrame, column: str, top: int = 12) -> DataFrame:
    """The most frequent values with their share of all rows, and one row for what is left."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = df.count()
    present = counts.where("value IS NOT NULL")
    best = present.orderBy(F.desc("n"), "value").limit(top)
    rest = present.join(best.select("value"), "value", "left_anti").agg(F.lit("(other)").alias("value"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return best.union(rest.select("value", "n")).withColumn("share", F.round(F.col("n") / max(total, 1), 6))


def outlier_counts(df: DataFrame, group: str, column: str) -> DataFrame:
    """Values beyond 1.5 interquartile ranges, and beyond 3 standard deviations, of their group."""
    v = F.col(column).cast("double")
    rows = df.where(F.col(group).isNotNull()).select(group, v.alias("v"))
    b = rows.groupBy(group).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).join(quantiles(rows, [group], "v", [0.25, 0.75]), group)
    t = rows.join(F.broadcast(b), group)  # a row for each group
    iqr = F.col("q")[1] - F.col("q")[0]
    out = (F.col("v") < F.col("q")[0] - 1.5 * iqr) | (F.col("v") > F.col("q")[1] + 1.5 * iqr)
    return t.groupBy(group).agg(F.count("v").alias("n"), F.count_if(out).alias("iqr_outliers"), F.count_if(F.abs(F.col("v") - F.col("m")) > 3 * F.col("s")).alias("z_outliers"))


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    t = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs))
    return t.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"{a}__{b}", 6).alias("r")) for a, b in pairs))))


def crosstab(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Counts of all pairs that occur, with the row's total and share."""
    t = df.groupBy(F.col(rows).alias("a"), F.col(columns).alias("b")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("a"))
    return t.select("a", "b", "n", total.alias("total"), F.round(F.col("n") / total, 6).alias("share"))


def dominant_category(df: DataFrame, attrs: list[str], most: float = 0.65) -> DataFrame:
    t = sensitive_distribution(df, attrs).groupBy("attr").agg(F.max_by("grp", F.struct("n", "grp")).alias("grp"), F.max("share").alias("share"))
    return t.withColumn("dominant", F.col("share") > most)


def issue_flags(df: DataFrame, attrs: list[str], target: str) -> DataFrame:
    t = representation_balance(df, attrs).join(label_imbalance(df, attrs, target), "attr")
    return t.select("attr", (F.col("size_ratio") > 3).alias("size_issue"), (F.col("max_difference") > 0.15).alias("rate_issue"))


