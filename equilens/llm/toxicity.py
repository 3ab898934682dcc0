"""Toxicity by a classifier chain.

Categories are predicted one after the other; the linear model of a category
sees the probabilities of the earlier ones besides the text's features. In
training these are out-of-fold, so that no model learns to trust a
probability that was fitted on the same row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilens.operators.models import without_summary

#: Labelled documents that the chain is fitted on, at most about.
TRAIN_DOCS = 20_000
FOLDS = 3
#: Features of a chain, at most: the words, word beginnings and marks that tell most about any category.
FEATURES = 600
#: Documents of a category that must have a feature before it is considered.
SUPPORT = 5
#: Lengths of word beginnings, which catch one stem with many endings.
STEMS = (4, 5, 6)
#: One labelled row in so many chooses the features.
CHOOSING = 2
#: Standard deviations by which a feature's mean must be larger in a category.
DEVIATIONS = 6.0
_WORDS = re.compile(r"[^\W\d_]+")
#: Repeated or lone marks; their surroundings tell a marred text from a good one.
_MARKS = re.compile(r"([^\w\s])\1+|(?<!\S)[^\w\s](?!\S)")
CAPITALS, REPEATED = "<capitals>", "<repeated>"
CACHE = 500_000


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def surface_of(text: str | None) -> dict[str, int]:
    """How often a text has each repeated or lone mark, words in capitals, and words that repeat the one before."""
    text = text or ""
    found: dict[str, int] = {}
    for m in _MARKS.finditer(text):
        mark = f"<{m[0][0]}>"
        found[mark] = found.get(mark, 0) + 1
    words = _WORDS.findall(text)
    capitals = sum(len(w) > 1 and w.isupper() for w in words)
    repeated = sum(map(str.__eq__, words, words[1:]))
    return found | ({CAPITALS: capitals} if capitals else {}) | ({REPEATED: repeated} if repeated else {})


def values_of(text: str | None) -> dict[str, float]:
    """The features of a text: log(1 + number of its different words with the feature, or of places with a mark)."""
    counts: dict[str, int] = surface_of(text)
    for w in set(words_of(text)):
        for f in features_of(w):
            counts[f] = counts.get(f, 0) + 1
    return {f: float(np.log1p(n)) for f, n in counts.items()}


@dataclass
class Chain:
    """weights[c] has a value for each feature, then for each earlier category, then the intercept."""

    categories: list[str]
    index: dict[str, int]
    weights: list[np.ndarray]


def _vectors(rows: DataFrame, index: dict[str, int], text: str) -> DataFrame:
    """Adds `x` (array<double>): the value of each feature in the text."""
    shared = rows.sparkSession.sparkContext.broadcast(index)  # FEATURES entries
    kept = rows.drop("x")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != text), "x array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(shared.value)
        for b in batches:
            x = np.zeros((b.num_rows, len(shared.value)))
            for i, t in enumerate(b.column(b.schema.get_field_index(text)).to_pylist()):
                at, value = find(t)
                x[i, at] = value
            rest = b.drop_columns([text])
            yield from pa.Table.from_batches([rest]).append_column("x", pa.array(list(x), pa.list_(pa.float64()))).to_batches()

    return kept.mapInArrow(run, schema)


class Finder:
    """The chosen features of a text and their values, by a cache over its words."""

    def __init__(self, index: dict[str, int]):
        self.index, self.known = index, {}

    def _learn(self, word: str) -> tuple[int, ...]:
        if len(self.known) >= CACHE:
            self.known.clear()
        got = self.known[word] = tuple(self.index[f] for f in features_of(word) if f in self.index)
        return got

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        get, learn = self.known.get, self._learn
        counts = {self.index[f]: n for f, n in surface_of(text).items() if f in self.index}
        for w in set(words_of(text)):
            got = get(w)
            if got is None:
                got = learn(w)
            for f in got:
                counts[f] = counts.get(f, 0) + 1
        at = np.array(sorted(counts), np.int64)
        return at, np.log1p(np.array([counts[f] for f in at.tolist()], float))


def categories_of(toxic: Column, quality: Column) -> dict[str, Column]:
    """The categories that the given labels tell apart: toxic documents, and those of them that are of low quality.

    Null where the labels don't decide.
    """
    poor = F.when(toxic == 0, 0.0).when(toxic == 1, 1.0 - quality)
    return {"toxic": toxic.cast("double"), "toxic_poor": poor.cast("double")}


def draw(labels: DataFrame, key: str = "doc_id", rows: int = TRAIN_DOCS) -> DataFrame:
    """At most about `rows` rows, by a hash of the key; all rows if there are no more."""
    n = labels.count()
    return labels.where(F.pmod(F.xxhash64(F.lit("toxicity"), key), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, rows / max(n, 1)))))


def fit(labelled: DataFrame, categories: list[str], key: str = "doc_id", text: str = "text", docs: int = TRAIN_DOCS) -> Chain:
    """Fits the chain on whole texts of at most about `docs` rows, drawn by a hash of the key.

    `labelled` has a column of 0 and 1 for each category; rows with a null in
    one of them are left out, a null text has no words, repeated rows count as
    often as they occur, and of equally good features the first by name counts
    first. One row in CHOOSING chooses the features, all are fitted on; the
    probabilities that later links are fed with are those of models fitted on
    the other folds. A category with one class only gets a constant model, and without
    rows the model of every category says one half.
    """
    rows = labelled.where(" AND ".join(f"`{c}` IS NOT NULL" for c in categories)).select(key, F.col(text).alias("text"), *categories)
    both = draw(rows, key, docs)
    drawn = both.where(F.pmod(F.xxhash64(F.lit("choose"), key), F.lit(CHOOSING)) == 0)

    # of each feature: rows that have it, sum of values and of their squares, and by category rows and sum of values
    names = ["n", "s", "q", *(f"{x}_{i}" for i in range(len(categories)) for x in "ns")]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(f, *v) for f, v in total.items()], columns=["feature", *names])

        for b in batches:
            y = np.column_stack([b[c].to_numpy(float) for c in categories])
            for t, own in zip(b["text"], y):
                for f, v in values_of(t).items():
                    parts = np.array([1.0, v, v * v, *(z for k in own for z in (k, k * v))])
                    if (at := total.get(f)) is None:
                        total[f] = parts
                    else:
                        at += parts
            if len(total) > 500_000:
                yield rows()
                total.clear()
        yield rows()

    sums = drawn.mapInPandas(count, "feature string, " + ", ".join(f"{n} double" for n in names)).groupBy("feature").agg(*(F.sum(c).alias(c) for c in names))
    whole = drawn.agg(F.count("*").cast("double").alias("n"), *(F.coalesce(F.sum(c), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(categories))).first()
    n, scores = max(whole["n"], 1), []
    spread = F.sqrt(F.greatest(F.col("q") / n - (F.col("s") / n) * (F.col("s") / n), F.lit(0.0)))
    for i in range(len(categories)):
        pos, neg = whole[f"c{i}"], whole["n"] - whole[f"c{i}"]
        # how much larger the feature's mean is in the category, in standard deviations
        apart = F.col(f"s_{i}") / max(pos, 1) - (F.col("s") - F.col(f"s_{i}")) / max(neg, 1)
        z = apart / (spread * (1 / max(pos, 1) + 1 / max(neg, 1)) ** 0.5 + 1e-9)
        scores.append(F.when(F.col(f"n_{i}") >= SUPPORT, z).otherwise(0.0))
    best = sums.withColumn("score", F.greatest(F.lit(0.0), *scores)).where(F.col("score") > DEVIATIONS).orderBy(F.desc("score"), "feature").limit(FEATURES)
    index = {r[0]: i for i, r in enumerate(best.select("feature").collect())}
    made = _vectors(both, index, "text").withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), key), F.lit(FOLDS))).select(key, "fold", "x", *categories).persist()
    made.count()
    weights, earlier = [], []
    try:
        for c in categories:
            size = len(index) + len(earlier)
            input_ = made.withColumn("v", array_to_vector(F.concat("x", F.array(*earlier).cast("array<double>"))))

            def learn(part: DataFrame, c: str = c, size: int = size):
                mean = part.agg(F.avg(c)).first()[0]
                if not size or mean is None or mean in (0.0, 1.0):
                    odds = 0.5 if mean is None else min(max(mean, 1e-3), 1 - 1e-3)
                    return None, np.concatenate([np.zeros(size), [np.log(odds / (1 - odds))]])
                m = LogisticRegression(featuresCol="v", labelCol=c, predictionCol="_p", rawPredictionCol="_r", probabilityCol="_q", regParam=1e-4, maxIter=50, standardization=False).fit(part)
                m = without_summary(m)
                return m, np.concatenate([m.coefficients.toArray(), [m.intercept]])

            # a fit is many small jobs, so the fits of a category run side by side
            folds = [] if c == categories[-1] else [input_.where(F.col("fold") != k) for k in range(FOLDS)]
            with ThreadPoolExecutor(1 + FOLDS) as pool:
                (_, whole_weights), *by_fold = pool.map(learn, [input_, *folds])
            weights.append(whole_weights)
            if not folds:
                break
            parts = []
            for k, (m, w) in enumerate(by_fold):
                own = input_.where(F.col("fold") == k)
                p = F.lit(float(1 / (1 + np.exp(-w[-1]))))
                parts.append(m.transform(own).withColumn(f"p_{c}", vector_to_array("_q")[1]).drop("_p", "_r", "_q") if m else own.withColumn(f"p_{c}", p))
            made_next = parts[0]
            for part in parts[1:]:
                made_next = made_next.union(part)
            made_next = made_next.drop("v").persist()
            made_next.count()
            made.unpersist()
            made = made_next
            earlier.append(f"p_{c}")
    finally:
        made.unpersist()
    return Chain(categories, index, weights)


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """`docs` without `text`, with p_<category> for each category of the chain.

    A null text has no words, and so gets the chain's intercepts. Columns named
    p_<category> are replaced. Repeated rows are answered one by one; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # FEATURES weights for each category
    names = [f"p_{c}" for c in chain.categories]
    kept = docs.drop(*names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != text), *(f"`{n}` double" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        find, n = Finder(c.index), len(c.index)
        for b in batches:
            found = [find(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            p = np.zeros((b.num_rows, len(names)))
            for k, w in enumerate(c.weights):
                z = np.array([w[at] @ value for at, value in found]) + p[:, :k] @ w[n : n + k] + w[-1]
                p[:, k] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            out = pa.Table.from_batches([b.drop_columns([text])])
            for k, name in enumerate(names):
                out = out.append_column(name, pa.array(p[:, k], pa.float64()))
            yield from out.to_batches()

    return kept.select(*(c for c in kept.columns if c != text), text).mapInArrow(run, schema)
