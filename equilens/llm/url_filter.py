"""URL filter: a list of rules, and gradient-boosted trees on lexical features for the rest.

DataFrame and ML functions of the JVM only.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilens.llm.common import hot_join, written

#: Host and path of a rule, and its verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Terms of a host that label a URL as bad for training. The list is known to be incomplete.
BAD_TERMS = ("casino", "pills", "spam", "viagra", "porn", "xxx", "jackpot", "betting", "payday", "replica", "warez", "torrent")
#: Labelled URLs that the trees are fitted on, at most about.
TRAIN_ROWS = 50_000
FOLDS = 4
#: Labels that the prior weighs in a suffix's statistic.
PRIOR = 20.0
FEATURES = ("url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "labels", "longest_label", "fragment", "suffix_rate")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end. Empty without ://."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    raw = F.coalesce(url, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(raw, pattern, 1), upper, upper.lower()), F.regexp_extract(raw, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null without one."""
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    best = F.array_max(F.array(*fits))
    return best["rule"], best["verdict"]


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    each = F.array_distinct(F.split(text, ""))
    return F.aggregate(F.filter(each, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - (n - F.length(F.replace(text, c))) / n * F.log2((n - F.length(F.replace(text, c))) / n))


def with_features(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, suffix and all features but suffix_rate; a null url counts as empty."""
    raw = F.coalesce(F.col(url), F.lit(""))
    host, path = host_and_path(F.col(url))
    query = F.regexp_extract(raw, r"\A[^#?]*\?([^#]*)", 1)
    return (
        pages.withColumns({"host": host, "path": path})
        .withColumns(
            {
                "suffix": F.substring_index("host", ".", -2),
                "url_length": F.length(raw).cast("double"),
                "host_length": F.length("host").cast("double"),
                "path_length": F.length("path").cast("double"),
                "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
                "digit_ratio": F.regexp_count(raw, F.lit("[0-9]")) / F.greatest(F.length(raw), F.lit(1)),
                "entropy": F.when(F.length("host") > 0, _entropy(F.col("host"))).otherwise(0.0),
                "parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
                "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
                "labels": F.size(F.split("host", r"\.")).cast("double"),
                "longest_label": F.array_max(F.transform(F.split("host", r"\."), F.length)).cast("double"),
                "fragment": raw.contains("#").cast("double"),
            }
        )
    )


def seed_label(host: Column, path: Column, rules=RULES) -> Column:
    """1 if the host has a bad term; else 0 if a rule allows the URL; else null: most URLs have no label.

    A host without a term may be bad all the same, so that it isn't taken for
    a good one unless somebody has vouched for it.
    """
    bad = F.lit(False)
    for term in BAD_TERMS:
        bad = bad | host.contains(term)
    _, verdict = rule_of(host, path, rules)
    return F.when(bad, 1.0).when(verdict == "allow", 0.0)


class UrlModel:
    """The trees (None without two classes), the statistics of all suffixes, and the share of bad ones among all URLs."""

    def __init__(self, model: GBTClassificationModel | None, suffixes: DataFrame | None, rows: int, prior: float):
        self.model, self.suffixes, self.rows, self.prior = model, suffixes, rows, prior

    def score(self, pages: DataFrame) -> DataFrame:
        """Adds p_block to rows with features."""
        if self.model is None:
            return pages.withColumn("p_block", F.lit(self.prior))
        rate = (F.col("bad") + PRIOR * self.prior) / (F.col("_n") + PRIOR)
        met = hot_join(pages, self.suffixes, "suffix", "_n", self.rows, "left")
        joined = met.withColumn("suffix_rate", F.coalesce(rate, F.lit(self.prior))).drop("_n", "bad")
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_x", handleInvalid="keep").transform(joined)
        return self.model.transform(vectors).withColumn("p_block", vector_to_array("probability")[1])


def fit(labelled: DataFrame, url: str = "url", label: str = "label", rows: int = TRAIN_ROWS) -> UrlModel:
    """Fits on at most about `rows` labelled URLs, drawn by a hash of the URL; null labels are URLs without one.

    The statistics of a suffix are the labelled bad ones among all its URLs,
    counted over the whole table. A training row's comes from the other folds,
    so that its own label doesn't leak into it. With fewer than two classes
    there are no trees and every URL gets the share of labelled bad ones, 0
    without rows. Repeated URLs count as often as they occur.
    """
    known = labelled.select(url, F.col(label).cast("double").alias("label"))
    n, n_known, n_bad = known.agg(F.count("*"), F.count("label"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    prior = n_bad / n if n else 0.0
    if not 0 < n_bad < n_known:
        return UrlModel(None, None, n, prior)
    host, _ = host_and_path(F.col(url))
    sized = known.select(url, "label", F.substring_index(host, ".", -2).alias("suffix"), F.pmod(F.xxhash64(host), F.lit(FOLDS)).alias("_fold"))
    by_fold = sized.groupBy("suffix", "_fold").agg(F.count("*").alias("_n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("bad"))
    by_fold = written(by_fold, "suffixes")
    whole = by_fold.groupBy("suffix").agg(F.sum("_n").alias("_n"), F.sum("bad").alias("bad"))
    share = F.lit(int(1_000_000 * min(1.0, rows / n_known)))
    drawn = sized.where(F.col("label").isNotNull() & (F.pmod(F.xxhash64(F.lit("url"), url), F.lit(1_000_000)) < share))
    drawn = written(with_features(drawn.drop("suffix"), url), "labelled-urls")  # about `rows` rows
    of = by_fold.join(drawn.select("suffix").distinct(), "suffix", "left_semi").groupBy("suffix").agg(
        F.sum("_n").alias("all_n"), F.sum("bad").alias("all_bad"), F.map_from_entries(F.collect_list(F.struct("_fold", F.struct("_n", "bad")))).alias("own")
    )
    own = F.col("own")[F.col("_fold")]
    rate = (F.col("all_bad") - own["bad"] + PRIOR * prior) / (F.col("all_n") - own["_n"] + PRIOR)
    weight = F.when(F.col("label") == 1, 0.5 * n_known / n_bad).otherwise(0.5 * n_known / (n_known - n_bad))
    train = drawn.join(of, "suffix").withColumns({"suffix_rate": rate, "_w": weight})
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(train).select("_x", "label", "_w")
    if vectors.select("label").distinct().count() < 2:  # the draw may miss a rare class
        return UrlModel(None, None, n, prior)
    model = GBTClassifier(featuresCol="_x", labelCol="label", weightCol="_w", maxIter=10, maxDepth=4, seed=7).fit(vectors)
    return UrlModel(model, whole, n, prior)


def judge(pages: DataFrame, model: UrlModel, key: str = "page_id", url: str = "url", rules=RULES, cut: float = 0.5) -> DataFrame:
    """(key, host, path, rule, verdict, p_block), one row for each row of `pages`: the rule's verdict, else the trees'.

    A null url and one without `://` have an empty host and path, and the
    verdict of the trees. Repeated rows are answered one by one; an empty table
    gives no rows. `key` may have any name and type.
    """
    scored = model.score(with_features(pages.select(F.col(key).alias("_key"), F.col(url).alias("_url")), "_url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    found = scored.select("_key", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("p_block") >= cut, "block").otherwise("allow")).alias("verdict"), "p_block")
    return found.withColumnRenamed("_key", key)
