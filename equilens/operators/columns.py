"""What is said about the columns of a table: types, roles, guidance, and tables over several datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from equilens.operators import profiling as D
from equilens.operators.statistics import ks_long

#: Names that hint at a target, an index and a sensitive attribute, in the order in which they are tried.
TARGET_NAMES = ("target", "label", "class", "outcome", "result", "heart_disease", "diagnosis", "y", "output")
INDEX_NAMES = ("index", "id", "row_id", "sample_id", "patient_id", "case_id")
LABEL_NAMES = ("target", "label", "class", "outcome", "y", "diagnosis", "disease", "heart_disease", "condition", "result")
SENSITIVE_NAMES = ("sex", "gender", "age", "age_group", "race", "ethnicity", "religion", "nationality", "disability", "marital_status")
SENSITIVE_PARTS = ("age", "sex", "gender", "race", "ethnic", "religion", "disab", "marital", "country", "national")
#: Numbers of bins that are offered.
BIN_COUNTS = (2, 5, 10)
#: Members of duplicate sets that a report lists.
LISTED = 1000


def basic_stats(df: DataFrame, target: str) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"), F.round(F.avg(target), 6).alias("prevalence"))


def inferred_type(profile: DataFrame) -> DataFrame:
    """(column, inferred): datetime, binary, numerical, categorical, text, or unknown without values."""
    numeric = F.col("kind").isin("integer", "float")
    t = F.when(F.col("n_unique") == 0, "unknown").when(F.col("kind") == "datetime", "datetime").when(F.col("n_unique") == 2, "binary")
    return profile.select("column", t.when(numeric, "numerical").when(F.col("n_unique") <= 20, "categorical").otherwise("text").alias("inferred"))


def date_columns(df: DataFrame) -> list[str]:
    """Text columns of which the 20 least different values are all dates; a job for each text column keeps 20 values a task."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    found = []
    for c in text:  # the schema's columns
        parsed = df.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c).limit(20).select(F.try_to_timestamp(c).alias("t")).agg(F.count("t"), F.count("*")).first()
        if parsed[1] and parsed[0] == parsed[1]:
            found.append(c)
    return found


def triage_column_type(profile: DataFrame, dates: list[str] = ()) -> DataFrame:
    """(column, type) by the cut-offs of the triage: nearly unique columns of more than 10 rows are identifiers."""
    rows = F.col("present") + F.col("n_missing")
    numeric = F.col("kind").isin("integer", "float")
    t = (
        F.when(F.col("n_unique") == 0, "unknown").when((F.col("kind") == "datetime") | F.col("column").isin(*dates, ""), "datetime")
        .when((F.col("n_unique") >= 0.99 * rows) & (rows > 10), "identifier").when(F.col("n_unique") == 2, "binary")
        .when(F.col("n_unique") <= 20, "categorical").when(numeric, "numerical").otherwise("text")
    )
    return profile.select("column", t.alias("type"))


def column_role(types: DataFrame, last: str, confirmed: dict[str, str] | None = None) -> DataFrame:
    """(column, role): identifier, label, sensitive or feature by type and name; the last column may be the label; what is confirmed wins."""
    name = F.lower(F.trim("column"))
    role = (
        F.when(F.col("type") == "identifier", "identifier").when(name.isin(*LABEL_NAMES), "label").when(name.isin(*SENSITIVE_NAMES), "sensitive")
        .when((F.col("column") == last) & (F.col("type") == "binary"), "label").otherwise("feature")
    )
    given = F.create_map(*(F.lit(x) for pair in confirmed.items() for x in pair))[F.col("column")] if confirmed else F.lit(None)
    return types.select("column", "type", F.coalesce(given, role).alias("role"))


def role_guess(profile: DataFrame, columns: list[str]) -> DataFrame:
    """(target, index): the first name that hints at them; else the last column, and the first one if it is nearly unique."""
    low = {c.lower(): c for c in reversed(columns)}
    target = next((low[n] for n in TARGET_NAMES if n in low), columns[-1])
    index = next((low[n] for n in INDEX_NAMES if n in low), None)
    first = profile.where(F.col("column") == columns[0])
    guess = F.lit(index) if index else F.max(F.when(F.col("distinct_ratio") >= 0.98, F.col("column")))
    return first.agg(F.lit(target).alias("target"), guess.alias("index"))


def binning_guidance(semantic: DataFrame) -> DataFrame:
    """(column, binnable, guidance, counts): whether and into how many bins a column may be cut.

    `semantic` has (column, kind, n_unique, n_missing, n_rows, semantic_type).
    """
    c, n = F.col, F.col("n_unique")
    numeric = c("kind").isin("integer", "float")
    missing = F.when(c("n_rows") > 0, 100 * c("n_missing") / c("n_rows")).otherwise(0.0)
    direct = (c("semantic_type") == "binary") | ((c("semantic_type") == "categorical") & ~numeric)
    guidance = (
        F.when(c("semantic_type") == "binary", "use_directly").when(c("semantic_type") == "identifier", "avoid").when(numeric & (missing >= 50), "caution")
        .when(numeric & n.between(3, 5), "limited_bins").when(numeric & (n < 20), "ok_for_binning").when(numeric, "great_for_binning").when(direct, "use_directly").otherwise("avoid")
    )
    offered = F.array(*map(F.lit, BIN_COUNTS))
    even = F.filter(offered, lambda k: (n % k == 0) & (k <= n))
    odd = F.filter(offered, lambda k: (n % k != 0) & (k <= n))
    own = F.when((n > 1) & (n <= 10), F.array(n.cast("int"))).otherwise(F.array().cast("array<int>"))
    counts = (
        F.when(c("semantic_type") == "binary", F.array(F.lit(2))).when(c("semantic_type") == "categorical", F.when(F.size(even) > 0, even).otherwise(own))
        .when(c("semantic_type") == "continuous", F.concat(even, odd)).otherwise(F.array().cast("array<int>"))
    )
    return semantic.select("column", guidance.isin("caution", "limited_bins", "ok_for_binning", "great_for_binning").alias("binnable"), guidance.alias("guidance"), counts.alias("counts"))


def sensitive_candidate(guided: DataFrame) -> DataFrame:
    """(column, score): 0.7 for a name that hints at a sensitive attribute, and for groups that can be compared; 0.1 at most where binning is advised against."""
    name = reduce(lambda p, q: p | q, (F.lower("column").contains(part) for part in SENSITIVE_PARTS))
    kind = F.when(F.col("semantic_type").isin("binary", "categorical"), 0.2).when(F.col("semantic_type") == "continuous", 0.1).otherwise(0.0)
    score = F.when(name, 0.7).otherwise(0.0) + kind
    return guided.select("column", F.round(F.when(F.col("guidance") == "avoid", F.least(score, F.lit(0.1))).otherwise(score), 2).alias("score"))


def described(df: DataFrame) -> DataFrame:
    """The column profile with semantic type, guidance and sensitive score: one row for each column."""
    profile = D.column_profile(df).withColumn("n_rows", F.col("present") + F.col("n_missing"))
    semantic = profile.join(D.semantic_type(profile).select("column", "semantic_type"), "column")
    guided = semantic.join(binning_guidance(semantic), "column")
    return guided.join(sensitive_candidate(guided), "column")


def quality_issues(profile: DataFrame, confirmed: list[str] = ()) -> DataFrame:
    """(column, issue): a fifth or more missing, one value at most, or a role that nobody has confirmed."""
    rows = F.col("present") + F.col("n_missing")
    issues = F.array(
        F.when((F.col("n_missing") >= F.greatest(F.lit(1), F.floor(rows * 0.2))) & (rows > 0), "high_missing"),
        F.when(F.col("n_unique") <= 1, "low_unique"),
        F.when(~F.col("column").isin(*confirmed, ""), "unconfirmed_role"),
    )
    return profile.select("column", F.explode(F.array_compact(issues)).alias("issue"))


def role_validation(semantic: DataFrame, roles: dict[str, str]) -> DataFrame:
    """(column, role, accepted): free text can be neither target nor sensitive; an index may be."""
    given = F.create_map(*(F.lit(x) for pair in roles.items() for x in pair))[F.col("column")]
    t = semantic.withColumn("role", given).where("role IS NOT NULL")
    return t.select("column", "role", ((F.col("role") == "index") | (F.col("semantic_type") != "text")).alias("accepted"))


def feature_distributions(df: DataFrame, top: int = 12) -> DataFrame:
    """(column, part, name, value): the most frequent values of columns that are categories, the quantiles of continuous ones.

    Values are counted in one grouping by (column, value); `top` is the report's size.
    """
    kinds = D.semantic_type(D.column_profile(df))
    counted = D.value_counts(df).where("value IS NOT NULL").join(F.broadcast(kinds), "column")  # a row for each column
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    most = counted.where("semantic_type IN ('binary', 'categorical')").withColumn("_r", place).where(F.col("_r") <= top)
    numeric = [c for c, t in df.dtypes if D.kind_of(t) in ("integer", "float")]
    shown = most.select("column", F.lit("value").alias("part"), F.col("value").alias("name"), F.col("n").cast("double").alias("value"))
    if not numeric:
        return shown
    spread = D.numeric_distribution(df, numeric).join(F.broadcast(kinds), "column").where("semantic_type = 'continuous'")
    names = ("min", "q1", "median", "q3", "max", "mean", "std")
    return shown.unionByName(spread.select("column", F.lit("quantile").alias("part"), F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names)))))


def dataset_characterize(df: DataFrame, target: str) -> DataFrame:
    """(section, item, value): size, balance of the target, duplicates, missing values and types, as one tidy table."""
    part = lambda t, section, item, value: t.select(F.lit(section).alias("section"), F.col(item).cast("string").alias("item"), F.col(value).cast("double").alias("value"))
    size = basic_stats(df, target).select(F.inline(F.array(*(F.struct(F.lit(n).alias("item"), F.col(n).cast("double").alias("value")) for n in ("rows", "columns", "prevalence")))))
    kinds = described(df)
    parts = [
        part(size, "size", "item", "value"), part(D.class_balance(df, target), "class", "class", "n"), part(D.duplicate_rows(df).withColumn("item", F.lit("rows")), "duplicates", "item", "duplicates"),
        part(kinds, "missing", "column", "n_missing"), part(kinds, "distinct", "column", "n_unique"), part(kinds, "sensitive", "column", "score"),
    ]
    return reduce(DataFrame.unionByName, parts)


def upload_profile(df: DataFrame) -> DataFrame:
    """What a new file shows at once: a row for each column."""
    return described(df).select("column", "kind", "semantic_type", "n_unique", "n_missing", "n_rows")


def dataset_summary(df: DataFrame, by: str, required: list[str]) -> DataFrame:
    """Rows, columns and missing values of each dataset, and whether all required columns have a value."""
    rest = [c for c in df.columns if c != by]
    missing = reduce(lambda p, q: p + q, (F.count_if(F.col(c).isNull()) for c in rest))
    complete = reduce(lambda p, q: p & q, (F.count(c) > 0 for c in required))
    return df.groupBy(by).agg(F.count("*").alias("rows"), F.lit(len(rest)).alias("columns"), missing.alias("missing"), complete.alias("has_required"))


def compare_profiles(df: DataFrame, by: str, target: str) -> DataFrame:
    t = df.groupBy(by).agg(F.count("*").alias("rows"), F.round(F.avg(target), 6).alias("prevalence"))
    return t.withColumn("share", F.round(F.col("rows") / F.sum("rows").over(Window.partitionBy()), 6))  # a row for each dataset


def distribution_rows(df: DataFrame, by: str, attrs: list[str]) -> DataFrame:
    """Groups of each dataset with their share, and whether it is below a tenth."""
    long = df.select(by, F.inline(F.array(*(F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("grp")) for a in attrs))))
    t = long.where("grp IS NOT NULL").groupBy(by, "attr", "grp").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(by, "attr"))
    return t.select(by, "attr", "grp", "n", F.round(share, 6).alias("share"), (F.round(share, 9) < 0.1).alias("under_tenth"))


def distribution_difference(df: DataFrame, by: str, attrs: list[str]) -> DataFrame:
    """The largest gap of a group's share between datasets; a group that a dataset lacks has the share 0 there."""
    n = df.select(by).distinct().agg(F.count("*").alias("_all"))
    t = distribution_rows(df, by, attrs).groupBy("attr", "grp").agg(F.max("share").alias("hi"), F.min("share").alias("lo"), F.count("*").alias("_k")).crossJoin(F.broadcast(n))  # one row
    gap = F.max(F.col("hi") - F.when(F.col("_k") < F.col("_all"), 0.0).otherwise(F.col("lo")))
    g = t.groupBy("attr").agg(F.round(gap, 6).alias("difference"))
    return g.withColumn("label", F.when(F.col("difference") < 0.05, "similar").when(F.col("difference") < 0.15, "minor").otherwise("different"))


def split_verification(df: DataFrame, split: str, attrs: list[str]) -> DataFrame:
    """Shares of the values of each attribute in training and test, and their difference."""
    t = distribution_rows(df, split, attrs).groupBy("attr", "grp")
    of = lambda s: F.coalesce(F.max(F.when(F.col(split) == s, F.col("share"))), F.lit(0.0))
    g = t.agg(of("train").alias("train_share"), of("test").alias("test_share"))
    return g.withColumn("difference", F.round(F.abs(F.col("train_share") - F.col("test_share")), 6))


def duplicate_row_ids(df: DataFrame, key: str, listed: int = LISTED) -> DataFrame:
    """Keys of all members of sets of rows that are equal but for the key; the first `listed`, which is the report's size.

    Sets are found by their counts: no set of equal rows meets in a task.
    """
    rest = [c for c in df.columns if c != key]
    sets = df.groupBy(*rest).agg(F.count("*").alias("_n")).where("_n > 1").select(*(F.col(c).alias(f"_{c}") for c in rest))
    on = reduce(lambda p, q: p & q, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in rest))
    return df.join(sets, on, "left_semi").select(key).orderBy(key).limit(listed)


def drift_matrix(df: DataFrame, by: str, reference: str, features: list[str]) -> DataFrame:
    """(dataset, feature, ks, p, strength): each dataset's features against the reference; strength is -log10 of p, 10 at most."""
    long = df.select(F.col(by).alias("dataset"), F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))))
    base = long.where(F.col("dataset") == reference).select("feature", "value", F.lit(True).alias("_ref"))
    others = df.select(by).where(F.col(by) != reference).distinct().withColumnRenamed(by, "dataset")
    both = long.where(F.col("dataset") != reference).withColumn("_ref", F.lit(False)).unionByName(base.crossJoin(F.broadcast(others)).select("dataset", "feature", "value", "_ref"))  # a row for each dataset
    t = ks_long(both, ["dataset", "feature"], F.col("_ref"), "value")
    return t.select("dataset", "feature", "ks", "p", F.round(-F.log10(F.greatest("p", F.lit(1e-10))), 4).alias("strength"))


def shift_rank(before: DataFrame, after: DataFrame, features: list[str]) -> DataFrame:
    """(feature, ks, rank): features by how far a transformation moved them; both frames are scaled to 0 and 1 by their ranges."""
    def scaled(df: DataFrame, side: bool) -> DataFrame:
        lo = df.agg(*(F.min(f).cast("double").alias(f"{f}__lo") for f in features), *(F.max(f).cast("double").alias(f"{f}__hi") for f in features))
        value = lambda f: F.when(F.col(f"{f}__hi") > F.col(f"{f}__lo"), F.round((F.col(f) - F.col(f"{f}__lo")) / (F.col(f"{f}__hi") - F.col(f"{f}__lo")), 9)).otherwise(0.0)
        t = df.crossJoin(F.broadcast(lo))  # one row
        return t.select(F.lit(side).alias("_ref"), F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), value(f).alias("value")) for f in features))))

    t = ks_long(scaled(before, True).unionByName(scaled(after, False)), ["feature"], F.col("_ref"), "value")
    return t.select("feature", "ks", F.row_number().over(Window.orderBy(F.desc("ks"), "feature")).alias("rank"))


def missing_rate_report(df: DataFrame) -> DataFrame:
    """Nulls of each column in percent, two decimals."""
    return D.missing_by_column(df).select("column", "missing", F.round(100 * F.col("share"), 2).alias("pct"))


def limitations(profile: DataFrame, sensitive: list[str], confirmed: list[str]) -> DataFrame:
    """(limitation, n): no sensitive attribute, missing values, columns that nobody has confirmed; only those that hold."""
    t = profile.agg(F.lit(0 if sensitive else 1).alias("no_sensitive"), F.sum("n_missing").alias("missing_values"), F.count_if(~F.col("column").isin(*confirmed, "")).alias("unconfirmed_columns"))
    names = ("no_sensitive", "missing_values", "unconfirmed_columns")
    return t.select(F.inline(F.array(*(F.struct(F.lit(n).alias("limitation"), F.col(n).cast("long").alias("n")) for n in names)))).where("n > 0")


def reference_quantiles(history: DataFrame, defaults: dict[str, tuple[float, ...]]) -> DataFrame:
    """(metric, source, min, p25, median, p75, max) from two past values or more, else from `defaults`."""
    q = F.percentile("value", F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0))))
    own = history.where("value IS NOT NULL").groupBy("metric").agg(q.alias("q"), F.count("*").alias("_n")).where("_n >= 2")
    listed = F.array(*(F.struct(F.lit(m).alias("metric"), F.array(*map(F.lit, v)).alias("d")) for m, v in defaults.items()))
    known = history.sparkSession.range(1).select(F.inline(listed))
    t = known.join(own, "metric", "full")
    values = F.coalesce("q", "d")
    source = F.when(F.col("q").isNotNull(), "history").otherwise("literature")
    return t.select("metric", source.alias("source"), *(F.round(values[i], 6).alias(n) for i, n in enumerate(("min", "p25", "median", "p75", "max"))))


def against_reference(values: DataFrame, quantiles: DataFrame) -> DataFrame:
    """(metric, value, percentile, above_p75): where a value stands among the reference's quantiles."""
    t = values.join(F.broadcast(quantiles), "metric")  # a row for each metric
    edges, v, out = [F.col(n) for n in ("min", "p25", "median", "p75", "max")], F.col("value"), None
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        inside = 25.0 * i + F.when(b > a, 25.0 * (v - a) / (b - a)).otherwise(0.0)
        out = F.when(v <= a, 25.0 * i).when(v <= b, inside) if out is None else out.when(v <= b, inside)
    return t.select("metric", "value", F.round(out.otherwise(100.0), 4).alias("percentile"), (v > F.col("p75")).alias("above_p75"))
