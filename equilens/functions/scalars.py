"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def top_weighted_key(c: Column) -> Column:
    """The key of the largest weight in text like {'a': 0.7, 'b': 0.3}; the first on ties, null without any."""
    pattern = r"['\"]([^'\"]+)['\"]\s*:\s*([0-9.eE+-]+)"
    keys, weights = F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.regexp_extract_all(c, F.lit(pattern), F.lit(2))
    pairs = F.transform(keys, lambda k, i: F.struct(F.get(weights, i).try_cast("double").alias("w"), (-i).alias("i"), k.alias("k")))
    return F.array_max(pairs)["k"]


def any_substring(c: Column, terms: list[str]) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.exists(F.array(*map(F.lit, terms)), lambda t: low.contains(F.lower(t))).cast("int")


def age_token(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "^age_", ""), "_to_", "-")


def fst_numeric(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "^FST", "").try_cast("double")


def skin_group(c: Column) -> Column:
    return F.when(c <= 2, "I-II").when(c <= 4, "III-IV").when(c.isNotNull(), "V-VI").otherwise("unknown")


def race_group(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t == "", "unknown").when(t.contains(","), "Multiple").otherwise(F.initcap(F.replace(t, F.lit("_"), F.lit(" "))))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def safe_cast(c: Column) -> Column:
    return c.try_cast("double")


def clip(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def bmi(weight: Column, height: Column) -> Column:
    metres = height / 100
    return F.round(F.when(height > 0, weight / (metres * metres)), 6)


def minmax_scale(c: Column) -> Column:
    lo, hi = F.array_min(c), F.array_max(c)
    return F.transform(c, lambda x: F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.0))


def normalize_attr_name(c: Column) -> Column:
    return F.regexp_replace(c, "_cat$", "")


def display_label(c: Column, labels: dict[str, str]) -> Column:
    """The label of a code; codes without one as they are."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))[c], c)


def display_rank(c: Column, order: list[str]) -> Column:
    """The place of a value in the order in which values are shown; those that aren't listed come last."""
    place = F.array_position(F.array(*map(F.lit, order)), c)
    return F.when(place > 0, place - 1).otherwise(len(order)).cast("int")


def bin_label(low: Column, high: Column, observed_low: Column, observed_high: Column, whole: bool) -> Column:
    """How a bin is shown: the observed range where values are whole numbers, else its edges with two decimals."""
    if whole:
        a, b = observed_low.cast("long").cast("string"), observed_high.cast("long").cast("string")
        return F.when(observed_low == observed_high, a).otherwise(F.concat(a, F.lit("-"), b))
    return F.concat(F.lit("("), F.format_string("%.2f", low), F.lit(", "), F.format_string("%.2f", high), F.lit("]"))


def percentile_position(c: Column, quantiles: list[float]) -> Column:
    """Where a value stands among minimum, quartiles and maximum, 0 to 100, linear between them."""
    steps = 100.0 / (len(quantiles) - 1)
    out = F.when(c <= quantiles[0], 0.0)
    for i, (a, b) in enumerate(zip(quantiles, quantiles[1:])):
        out = out.when(c <= b, steps * i + (steps * (c - a) / (b - a) if b > a else 0.0))
    return F.round(out.when(c.isNotNull(), 100.0), 6)
