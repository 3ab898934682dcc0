"""Leak-free preparation: splits, folds, imputation, scaling, weights, resampling and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equilens.operators.perturbation import order_of
from equilens.operators.statistics import quantiles, running


#: Rows of one slice of `ranked`.
SLICE = 1_000_000


def ranked(df: DataFrame, key: str, strata: list[str], seed: int = 42, slice_rows: int = SLICE) -> DataFrame:
    """Adds _rank (from 1) in the stable order of each stratum, and _n, the stratum's rows.

    The order is that of a hash of the key, then the key: the same on every run. A stratum isn't sorted in one task:
    its rows are cut into slices along the order, numbered within a slice, and a slice starts where those before it
    end. Null is a stratum of its own.
    """
    slices = max(1, -(-df.count() // slice_rows))
    t = df.withColumn("_u", order_of(key, str(seed)))
    t = t.withColumns({"_slice": F.floor(F.col("_u") * slices), "_stratum": F.to_json(F.struct(*strata)) if strata else F.lit("")})
    sizes = t.groupBy("_stratum", "_slice").agg(F.count("*").alias("_m"))
    whole = Window.partitionBy("_stratum")
    before = F.sum("_m").over(whole.orderBy("_slice")) - F.col("_m")
    starts = sizes.select("_stratum", "_slice", before.alias("_before"), F.sum("_m").over(whole).alias("_n"))
    within = F.row_number().over(Window.partitionBy("_stratum", "_slice").orderBy("_u", key))
    numbered = t.withColumn("_rank", within).join(starts, ["_stratum", "_slice"])
    return numbered.select(*df.columns, (F.col("_rank") + F.col("_before")).alias("_rank"), "_n")


def split_stratified(df: DataFrame, key: str, strata: list[str], test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds `split`. In each stratum the first round(n x share) rows of a stable order are the test rows; none is lost.

    While a stratum has fewer than two rows, the last attribute is left out.
    """
    kept = list(strata)
    while len(kept) > 1 and df.groupBy(*kept).count().agg(F.min("count")).first()[0] == 1:
        kept.pop()
    t = ranked(df, key, kept, seed)
    return t.withColumn("split", F.when(F.col("_rank") <= F.round(F.col("_n") * test), "test").otherwise("train")).drop("_rank", "_n")


def _groups(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, _label, _rows): the most frequent label of each group, the least one on ties, and its rows."""
    counts = df.groupBy(F.col(group), F.col(label).alias("_label")).agg(F.count("*").alias("_c"))
    order = F.struct("_c", F.struct((-F.col("_label")).alias("least")))
    return counts.groupBy(group).agg(F.max_by("_label", order).alias("_label"), F.sum("_c").alias("_rows"))


def split_grouped(df: DataFrame, group: str, label: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds `split`: all rows of a group are on one side. Of the groups of each modal label the first round(n x share) are for the test."""
    t = ranked(_groups(df, group, label), group, ["_label"], seed)
    side = t.select(group, F.when(F.col("_rank") <= F.round(F.col("_n") * test), "test").otherwise("train").alias("split"))
    return df.join(side, group)


def split_group_stratified(df: DataFrame, group: str, label: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds `split`: as `split_grouped`, but groups go to the test until they hold the share of their label's rows."""
    t = _groups(df, group, label).withColumn("_u", order_of(group, str(seed)))
    t = running(t, ["_label"], "_u", {"_rows": "_upto"})
    whole = t.groupBy("_label").agg(F.sum("_rows").alias("_all"))
    t = t.join(F.broadcast(whole), "_label")  # a row for each label
    side = t.select(group, F.when(F.col("_upto") - F.col("_rows") < F.col("_all") * test, "test").otherwise("train").alias("split"))
    return df.join(side, group)


def folds_stratified(df: DataFrame, key: str, strata: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Adds `fold`: the rows of each stratum go round the folds in a stable order."""
    return ranked(df, key, strata, seed).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_n")


def scale_fit_apply(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """z-scores by the training rows' mean and population deviation; a constant column becomes 0."""
    stats = df.where(train).agg(*(x for c in columns for x in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))))
    t = df.crossJoin(F.broadcast(stats))  # one row of statistics
    scaled = {c: F.when(F.col(f"{c}__s") > 0, (F.col(c) - F.col(f"{c}__m")) / F.col(f"{c}__s")).otherwise(0.0) for c in columns}
    return t.withColumns(scaled).select(*df.columns)


def _fills(df: DataFrame, numeric: list[str], other: list[str]) -> DataFrame:
    """One row: the median or most frequent value (the least on ties) of each column as <column>__v."""
    cell = lambda cs, kind: F.inline(F.array(*(F.struct(F.lit(c).alias("_c"), F.col(c).cast(kind).alias("_v")) for c in cs)))
    row = df.sparkSession.range(1).select(F.lit(1).alias("_one"))
    if numeric:
        q = quantiles(df.select(cell(numeric, "double")), ["_c"], "_v", [0.5]).select("_c", F.col("q")[0].alias("_v"))
        row = row.crossJoin(q.agg(*(F.max(F.when(F.col("_c") == c, F.col("_v"))).alias(f"{c}__v") for c in numeric)))
    if other:
        counts = df.select(cell(other, "string")).where("_v IS NOT NULL").groupBy("_c", "_v").agg(F.count("*").alias("_n"))
        best = counts.groupBy("_c").agg(F.min_by("_v", F.struct((-F.col("_n")).alias("n"), "_v")).alias("_v"))
        row = row.crossJoin(best.agg(*(F.max(F.when(F.col("_c") == c, F.col("_v"))).alias(f"{c}__v") for c in other)))
    return row.drop("_one")


def impute_profile(df: DataFrame, numeric: list[str], other: list[str]) -> DataFrame:
    """Nulls of a single table by its own medians and most frequent values, for measures only: nothing is fitted on it."""
    return impute_fit_apply(df, numeric, other, F.lit(True))


def encode_labels(train: DataFrame, test: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Both tables with <column>_code: the place of the value among the training values in their order.

    A test value that training lacks is an error, raised when its row is read.
    """
    values = train.where(F.col(column).isNotNull()).select(column).distinct()
    codes = values.select(F.array_sort(F.collect_list(column)).alias("_all"))  # a code for each category
    place = F.array_position("_all", F.col(column)) - 1
    unseen = F.raise_error(F.concat(F.lit(f"{column}: unseen value "), F.col(column).cast("string")))
    code = F.when(F.col(column).isNull(), F.lit(None)).when(place < 0, unseen).otherwise(place).cast("int")
    return tuple(df.crossJoin(F.broadcast(codes)).withColumn(f"{column}_code", code).drop("_all") for df in (train, test))


def fold_preprocess(df: DataFrame, numeric: list[str], fold: str = "fold", k: int = 5) -> DataFrame:
    """(fold_no, side, columns): for every fold its training and test rows, imputed and scaled by its training rows alone.

    The statistics of all folds come from one grouping; rows are repeated once for each fold.
    """
    t = df.withColumn("fold_no", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    t = t.withColumn("side", F.when(F.col("fold_no") == F.col(fold), "test").otherwise("train"))
    long = t.where("side = 'train'").select("fold_no", F.inline(F.array(*(F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in numeric))))
    medians = quantiles(long, ["fold_no", "_c"], "_v", [0.5]).select("fold_no", "_c", F.col("q")[0].alias("_med"))
    filled = long.join(F.broadcast(medians), ["fold_no", "_c"]).withColumn("_v", F.coalesce("_v", "_med"))  # a row for each fold and column
    stats = filled.groupBy("fold_no", "_c").agg(F.max("_med").alias("_med"), F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_s"))
    of = lambda c, x: F.max(F.when(F.col("_c") == c, F.col(x))).alias(f"{c}__{x}")
    wide = stats.groupBy("fold_no").agg(*(of(c, x) for c in numeric for x in ("_med", "_m", "_s")))
    z = {c: F.when(F.col(f"{c}___s") > 0, (F.coalesce(F.col(c).cast("double"), F.col(f"{c}___med"), F.lit(0.0)) - F.col(f"{c}___m")) / F.col(f"{c}___s")).otherwise(0.0) for c in numeric}
    return t.join(F.broadcast(wide), "fold_no").withColumns(z).select("fold_no", "side", *df.columns)


def impute_fit_apply(df: DataFrame, numeric: list[str], other: list[str], train: Column) -> DataFrame:
    """The training rows' median or most frequent value for nulls; 0 or `unknown` where there is none."""
    t = df.crossJoin(F.broadcast(_fills(df.where(train), numeric, other)))  # one row
    filled = {c: F.coalesce(c, f"{c}__v", F.lit(0.0)) for c in numeric} | {c: F.coalesce(F.col(c), F.col(f"{c}__v"), F.lit("unknown")) for c in other}
    return t.withColumns(filled).select(*df.columns)


def reweight(df: DataFrame, target: str, attr: str) -> DataFrame:
    """Adds `weight` = n / (cells x rows of the cell of target and group). The counts are joined back, so no cell meets in one task."""
    cells = df.groupBy(F.col(target).alias("_t"), F.col(attr).alias("_a")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy()
    cells = cells.select("_t", "_a", (F.sum("_c").over(w) / (F.count("*").over(w) * F.col("_c"))).alias("weight"))  # a row for each cell
    on = F.col(target).eqNullSafe(F.col("_t")) & F.col(attr).eqNullSafe(F.col("_a"))
    return df.join(F.broadcast(cells), on).drop("_t", "_a")


def undersample(df: DataFrame, key: str, target: str, seed: int = 42) -> DataFrame:
    """As many rows of each class as the smallest has, by a stable order."""
    least = df.groupBy(target).count().agg(F.min("count")).first()[0] or 0
    return ranked(df, key, [target], seed).where(F.col("_rank") <= least).drop("_rank", "_n")


def oversample(df: DataFrame, key: str, target: str, seed: int = 42) -> DataFrame:
    """Every class grows to the size of the largest by copies of its rows; `_copy` numbers them from 0."""
    most = df.groupBy(target).count().agg(F.max("count")).first()[0] or 0
    t = ranked(df, key, [target], seed)
    copies = F.floor(most / F.col("_n")) + (F.col("_rank") <= most % F.col("_n")).cast("int")
    return t.select(*df.columns, F.explode(F.sequence(F.lit(0), (copies - 1).cast("int"))).alias("_copy"))


def extend_sensitive(new: DataFrame, rows: DataFrame, key: str, attrs: list[str]) -> DataFrame:
    """`new` rows with the sensitive values of rows drawn from the originals by a hash; `key` is that of `new` and of `rows`."""
    n = rows.count()
    numbered = ranked(rows.select(key, *attrs), key, []).select(*attrs, (F.col("_rank") - 1).alias("_at"))
    drawn = new.withColumn("_at", F.floor(order_of(key, "extend") * n))
    return drawn.join(numbered, "_at").drop("_at")


def sample_stable(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by the order of a hash: the same ones on every run."""
    return df.withColumn("_u", order_of(key, str(seed))).orderBy("_u", key).limit(n).drop("_u")


def sample_stratified(df: DataFrame, key: str, by: str, cap: int, seed: int = 42) -> DataFrame:
    """About `cap` rows, in proportion to the classes; all rows if there are no more."""
    n = df.count()
    return ranked(df, key, [by], seed).where(F.col("_rank") <= F.round(F.lit(cap) * F.col("_n") / n)).drop("_rank", "_n") if n > cap else df


def sample_near_threshold(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows near the decision threshold by a stable order; from all rows if none is near. `df` has near_threshold."""
    near = df.where("near_threshold")
    return sample_stable(df if near.isEmpty() else near, key, n, seed)


def sample_cells(df: DataFrame, key: str, attrs: list[str], each: int, budget: int, seed: int = 42) -> DataFrame:
    """(key, attr, grp, outcome): up to `each` rows of every cell of attribute, group and outcome, `budget` in all, no row twice.

    A row that several attributes pick counts for the first one. `df` has outcome.
    """
    order = F.create_map(*(F.lit(x) for i, a in enumerate(attrs) for x in (a, i)))
    cells = df.select(key, "outcome", F.inline(F.array(*(F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("grp")) for a in attrs)))).where("grp IS NOT NULL")
    picked = ranked(cells, key, ["attr", "grp", "outcome"], seed).where(F.col("_rank") <= each)
    once = picked.groupBy(key).agg(F.min_by(F.struct("attr", "grp", "outcome", "_rank"), order[F.col("attr")]).alias("_x")).select(key, "_x.*")
    return once.orderBy(order[F.col("attr")], "grp", "outcome", "_rank").limit(budget).drop("_rank")


def validity_constraints(df: DataFrame, rules: dict[str, dict], action: str = "drop") -> DataFrame:
    """Drops or flags rows that break a rule: least, most, allow_zero, allow_null (default true)."""
    out, bad_any = df, F.lit(False)
    for c, r in rules.items():
        v = F.col(c)
        bad = F.lit(False)
        if "least" in r:
            bad = bad | (v < r["least"])
        if "most" in r:
            bad = bad | (v > r["most"])
        if not r.get("allow_zero", True):
            bad = bad | (v == 0)
        bad = F.coalesce(bad, F.lit(False))
        if not r.get("allow_null", True):
            bad = bad | v.isNull()
        if action == "flag":
            out = out.withColumn(f"{c}_invalid", bad)
        bad_any = bad_any | bad
    return out if action == "flag" else df.where(~bad_any)
