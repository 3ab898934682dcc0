"""Nearest neighbours of all rows or of a query set among all rows, and the measures that rest on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equilens.operators.graph import shared_folder
from equilens.operators.statistics import quantiles

#: Up to so many queries and pairs every pair is compared; rows of a batch that are compared with all queries at once.
SCAN_QUERIES, SCAN_PAIRS, STEP = 4000, 1_000_000_000, 256
#: Rows of a leaf of the search, queries of a leaf that meet them in one task, and pairs compared at once there.
LEAF_ROWS, BLOCK_ROWS, STEP_PAIRS = 2000, 4000, 1_000_000
#: Rows of a cell, at most; a leaf's rows are cut into cells where its queries meet them.
CELL_ROWS = 64
#: Leaves whose numbers are alike up to so many bits meet their queries in one call.
LEAF_BITS = 4
#: Rows of the sample that splits the leaves: at least so many in all and for each leaf.
SAMPLE, SAMPLE_LEAF = 100_000, 20


class _Best:
    """The k best rows of each query so far, and where it is asked for the best row of each label."""

    def __init__(self, queries: int, k: int, per_label: bool):
        self.queries, self.k, self.per_label = queries, k, per_label
        none = np.empty(0, np.int64)
        self.rows = [none, np.empty(0), none, none]  # query, distance, key, label
        self.new: list[list[np.ndarray]] = []
        self.pending = 0
        self.worst = np.full(queries, np.inf)

    def add(self, q: np.ndarray, d: np.ndarray, i: np.ndarray, y: np.ndarray) -> None:
        self.new.append([q, d, i, y])
        self.pending += len(q)
        if self.pending > max(10_000, len(self.rows[0]) // 2):
            self.settle()

    def settle(self) -> None:
        q, d, i, y = (np.concatenate([x, *(n[c] for n in self.new)]) for c, x in enumerate(self.rows))
        order = np.lexsort((i, d, q))
        q, d, i, y = q[order], d[order], i[order], y[order]
        rank = np.arange(len(q)) - np.searchsorted(q, np.arange(self.queries))[q]
        kept = rank < self.k
        self.worst[q[rank == self.k - 1]] = d[rank == self.k - 1]
        if self.per_label:
            own = np.lexsort((np.arange(len(q)), y, q))
            first = np.ones(len(q), bool)
            first[1:] = (q[own][1:] != q[own][:-1]) | (y[own][1:] != y[own][:-1])
            kept[own[first]] = True
        self.rows, self.new, self.pending = [q[kept], d[kept], i[kept], y[kept]], [], 0


def _tidy(df: DataFrame, key: str, label: str, features: list[str], by: str | None) -> DataFrame:
    """(_id, _y, _by, _x0, ...) of the rows without a null."""
    group = [F.col(by).cast("string").alias("_by")] if by else [F.lit("").alias("_by")]
    own = df.dropna(subset=[key, label, *features, *([by] if by else [])])
    return own.select(F.col(key).cast("long").alias("_id"), F.col(label).cast("long").alias("_y"), *group, *(F.col(f).cast("double").alias(f"_x{n}") for n, f in enumerate(features)))


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the folder that all executors share."""
    path = shared_folder(df.sparkSession, "neighbours")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranked(found: DataFrame, key: str, k: int, by: str | None, per_label: bool) -> DataFrame:
    order = ["distance", "neighbour"]
    out = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
    if per_label:
        out = out.withColumn("label_rank", F.row_number().over(Window.partitionBy("id", "other").orderBy(*order)))
        out = out.withColumn("rank", F.least("rank", F.lit(k + 1)))
    kept = out.where((F.col("rank") <= k) | (F.col("label_rank") == 1)) if per_label else out.where(F.col("rank") <= k)
    return kept.select(*_names(key, by), *(["label_rank"] if per_label else []))


def _order(key: str, by: str | None) -> list[str]:
    return [key, *([by] if by else []), "own", "rank", "neighbour", "other", "distance"]


def _names(key: str, by: str | None) -> list[Column | str]:
    return [F.col("id").alias(key), *([F.col("grp").alias(by)] if by else []), "own", "rank", "neighbour", "other", "distance"]


def _listed(found: DataFrame, key: str, by: str | None, *more: str) -> DataFrame:
    return found.select(F.col("_id").alias(key), F.col("_y").alias("own"), *([F.col("_by").alias(by)] if by else []), F.col("_found").alias("found"), *more)


def _exploded(lists: DataFrame, key: str, by: str | None) -> DataFrame:
    """A row for each neighbour of a list."""
    names = [key, "own", *([by] if by else [])]
    one = lists.select(*names, F.posexplode("found").alias("at", "one"))
    return one.select(*names, (F.col("at") + 1).alias("rank"), "one.*").select(*names, "rank", "neighbour", "other", "distance")


def _searched(asked: DataFrame, rows: DataFrame, key: str, features: int, k: int, by: str | None, per_label: bool, *how) -> DataFrame:
    found = _search(asked, rows, features, k, per_label, *how)
    if per_label:
        return _ranked(found.select(F.col("_id").alias("id"), F.col("_y").alias("own"), F.col("_by").alias("grp"), F.inline("_found")), key, k, by, per_label)
    return _exploded(_listed(found, key, by), key, by).select(*_order(key, by))


def knn_join(queries: DataFrame, rows: DataFrame, key: str, features: list[str], k: int, label: str, by: str | None = None, per_label: bool = False) -> DataFrame:
    """(key, own, rank, neighbour, other, distance): the k rows nearest to each query, itself left out.

    Euclidean over `features`, rounded to 9 decimals; ties go to the smaller key. `key` and `label` are whole
    numbers; `own` and `other` are the labels of query and neighbour. Rows with a null are left out.

    With `by`, only rows of the query's own group are its neighbours, all groups in one job; the result has the group
    as text. With `per_label` the nearest row of each label is there too, and `label_rank` counts within a label (of a
    label beyond its nearest row only those among the k nearest); a row that isn't among the k nearest has rank k + 1.

    At most SCAN_PAIRS pairs of at most SCAN_QUERIES queries are all compared in one pass; beyond that rows are searched
    by partitions of space, whose work grows with the queries, not with queries times rows.
    """
    asked, all_rows = (_tidy(d, key, label, features, by) for d in (queries, rows))
    n_asked, n_rows = asked.count(), rows.count()  # rows with a null count, which costs no look at the features
    if n_asked <= SCAN_QUERIES and n_asked * n_rows <= SCAN_PAIRS:
        return _ranked(_scan(asked, all_rows, len(features), k, per_label), key, k, by, per_label)
    return _searched(asked, all_rows, key, len(features), k, by, per_label, LEAF_ROWS, n_asked, n_rows)


def knn_lists(queries: DataFrame, rows: DataFrame, key: str, features: list[str], k: int, label: str, by: str | None = None) -> DataFrame:
    """(key, own, by, found): the neighbours of `knn_join` as a list in order, one row for each query that has any.

    What is counted over a list needs no row for each neighbour and no grouping by the query.
    """
    asked, all_rows = (_tidy(d, key, label, features, by) for d in (queries, rows))
    return _listed(_lists(asked, all_rows, len(features), k, asked.count(), rows.count()), key, by)


def _lists(asked: DataFrame, rows: DataFrame, features: int, k: int, n_asked: int, n_rows: int) -> DataFrame:
    """(_id, _y, _by, _x0, ..., _found) by either way."""
    if n_asked <= SCAN_QUERIES and n_asked * n_rows <= SCAN_PAIRS:
        one = F.struct("distance", "neighbour", "other")
        found = _scan(asked, rows, features, k, False).groupBy(F.col("id").alias("_id")).agg(F.slice(F.array_sort(F.collect_list(one)), 1, k).alias("_found"))  # k rows a task
        return asked.join(found, "_id")
    return _search(asked, rows, features, k, False, LEAF_ROWS, n_asked, n_rows).where(F.size("_found") > 0)


def knn_labels(queries: DataFrame, rows: DataFrame, key: str, features: list[str], k: int, label: str, by: str | None = None) -> DataFrame:
    """(key, own, by, found, within, across, across_key): `knn_lists`, and the distance of the nearest row of the query's own label and of another, and the key of the latter.

    A label that is among the k nearest has its nearest row there; only queries without a row of some label there search
    the rows of that label, for one row. Null where there is none.
    """
    asked, all_rows = (_tidy(d, key, label, features, by) for d in (queries, rows))
    n_asked, n_rows, xs = asked.count(), rows.count(), [f"_x{f}" for f in range(len(features))]
    labels = [r[0] for r in all_rows.select("_y").distinct().orderBy("_y").collect()]  # the classes
    near = written(_lists(asked, all_rows, len(features), k, n_asked, n_rows))
    lacks = F.array_except(F.array(*map(F.lit, labels)).cast("array<long>"), F.col("_found.other"))
    lacking = written(near.select("_id", "_y", "_by", *xs, F.explode(lacks).alias("_label")))
    more = _search(lacking, all_rows, len(features), 1, True, LEAF_ROWS, lacking.count(), n_rows).groupBy("_id").agg(F.array_sort(F.flatten(F.collect_list("_found"))).alias("_more"))  # a row for each label
    near = near.where(F.size(lacks) == 0).withColumn("_more", F.array().cast(FOUND)).unionByName(near.where(F.size(lacks) > 0).join(more, "_id", "left"))
    every = F.concat("_found", F.coalesce("_more", F.array().cast(FOUND)))  # a label's first row is its nearest
    first = lambda same: F.get(F.filter(every, lambda r: (r["other"] == F.col("_y")) == same), F.lit(0))
    return _listed(near.withColumns({"within": first(True)["distance"], "_across": first(False)}), key, by, "within", F.col("_across.distance").alias("across"), F.col("_across.neighbour").alias("across_key"))


def knn_partitions(queries: DataFrame, rows: DataFrame, key: str, features: list[str], k: int, label: str, leaf_rows: int = LEAF_ROWS, report: dict | None = None, by: str | None = None, per_label: bool = False) -> DataFrame:
    """The same as `knn_join`, always by partitions. `report` is given the number of leaves and of visits a query."""
    asked, all_rows = (_tidy(d, key, label, features, by) for d in (queries, rows))
    return _searched(asked, all_rows, key, len(features), k, by, per_label, leaf_rows, asked.count(), rows.count(), report)


def _scan(asked: DataFrame, rows: DataFrame, features: int, k: int, per_label: bool) -> DataFrame:
    """All pairs: the queries are broadcast, and a task keeps the k best of its rows for each."""
    schema = "id long, own long, grp string, neighbour long, other long, distance double"
    own = asked.orderBy("_by", "_id").collect()  # at most SCAN_QUERIES
    groups = sorted({r._by for r in own})
    code = {g: c for c, g in enumerate(groups)}
    first = np.searchsorted([code[r._by] for r in own], np.arange(len(groups) + 1))
    ids, labels = np.array([(r._id, r._y) for r in own], np.int64).reshape(-1, 2).T
    places = np.array([tuple(r)[3:] for r in own], float).reshape(len(own), features)
    shared = rows.sparkSession.sparkContext.broadcast((code, first, ids, labels, places))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, first, asked_ids, asked_labels, ask = shared.value
        state = _Best(len(asked_ids), k, per_label)
        for b in batches:
            of = np.array([code.get(g, -1) for g in b.column(2).to_pylist()], np.int64)
            order = np.argsort(of, kind="stable")
            order = order[np.searchsorted(of[order], 0) :]  # rows of no asked group go
            of = of[order]
            ids, labels = (b.column(c).to_numpy(zero_copy_only=False)[order] for c in (0, 1))
            x = np.column_stack([b.column(c + 3).to_numpy(zero_copy_only=False) for c in range(features)])[order]
            for g in np.unique(of).tolist():
                at, end = np.searchsorted(of, (g, g + 1)).tolist()
                mine = slice(int(first[g]), int(first[g + 1]))
                for s in range(at, end, STEP):
                    e = min(end, s + STEP)
                    far = np.zeros((mine.stop - mine.start, e - s))
                    for f in range(features):
                        far += (ask[mine, f, None] - x[None, s:e, f]) ** 2
                    far = np.round(np.sqrt(far), 9)
                    near = far <= state.worst[mine, None]
                    if per_label:  # the nearest of each label in this step
                        for y in np.unique(labels[s:e]).tolist():
                            own_label = np.where(labels[s:e] == y, far, np.inf)
                            own_label[asked_ids[mine, None] == ids[None, s:e]] = np.inf
                            near |= (own_label == own_label.min(1, keepdims=True)) & np.isfinite(own_label)
                    a, c = np.nonzero(near & (asked_ids[mine, None] != ids[None, s:e]))
                    state.add(a + mine.start, far[a, c], ids[s + c], labels[s + c])
        state.settle()
        q, d, i, y = state.rows
        names = pa.array([g for g, n in zip(code, np.diff(first).tolist()) for _ in range(n)], pa.string()).take(pa.array(q))
        yield pa.RecordBatch.from_arrays([pa.array(asked_ids[q]), pa.array(asked_labels[q]), names, pa.array(i, pa.int64()), pa.array(y, pa.int64()), pa.array(d, pa.float64())], ["id", "own", "grp", "neighbour", "other", "distance"])

    return rows.mapInArrow(best, schema)


@dataclass
class Splits:
    """k-d trees of several parts as arrays by node: `left` is the first of a node's two children, -1 for a leaf; rows with a value above `cut` go right.

    `roots` are the parts with a tree; any other part is one leaf, -1. `low` and `high` bound the rows below a node; a
    node without rows has no volume (low above high). Children come after their parent.
    """

    roots: dict[str, int]
    left: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def start(self, parts: pd.Series) -> np.ndarray:
        return parts.map(self.roots).fillna(-1).to_numpy(np.int64)

    def leaf_of(self, parts: pd.Series, x: np.ndarray) -> np.ndarray:
        at = self.start(parts)
        row = np.flatnonzero(at >= 0)
        while len(row := row[self.left[at[row]] >= 0]):
            own = at[row]
            at[row] = self.left[own] + (x[row, self.feature[own]] > self.cut[own])
        return at

    def within(self, parts: pd.Series, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves whose bounds lie within each row's reach, level by level: a box and a ball meet, or the nodes below are out."""
        at = self.start(parts)
        row = np.flatnonzero(at >= 0)
        rows, leaves = [np.flatnonzero(at < 0)], [at[at < 0]]
        at = at[row]
        while len(row):
            gap = np.maximum(np.maximum(self.low[at] - x[row], x[row] - self.high[at]), 0)
            near = (self.low[at] <= self.high[at]).all(1) & (np.sqrt((gap * gap).sum(1)) <= reach[row])
            row, at = row[near], at[near]
            leaf = self.left[at] < 0
            rows.append(row[leaf]), leaves.append(at[leaf])
            row, at = np.concatenate([row[~leaf]] * 2), np.concatenate([self.left[at[~leaf]], self.left[at[~leaf]] + 1])
        return np.concatenate(rows), np.concatenate(leaves)

    def bounded(self, leaf: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Sets the bounds of the given leaves, and so those of all nodes above."""
        self.low[:], self.high[:] = np.inf, -np.inf
        self.low[leaf], self.high[leaf] = low, high
        for n in range(len(self.left) - 1, -1, -1):
            if (c := self.left[n]) >= 0:
                self.low[n], self.high[n] = self.low[c : c + 2].min(0), self.high[c : c + 2].max(0)


def splits_of(parts: np.ndarray, x: np.ndarray, share: float, leaf_rows: int) -> tuple[Splits, list[int]]:
    """Trees from a sample of `share` of all rows, and the leaves that repeat one place more often than `leaf_rows`.

    Nodes are split at medians, each along the feature of largest spread, until a leaf has about `leaf_rows` of all rows.
    Where the median is the largest value the middle of the range is taken instead, and a node whose rows are all equal
    is a leaf. Bounds are to be set from all rows.
    """
    roots, left, feature, cut, crowded = {}, [], [], [], []
    order = np.argsort(parts, kind="stable")
    names, starts = np.unique(parts[order], return_index=True)
    todo = []
    for name, own in zip(names.tolist(), np.split(order, starts[1:])):
        if len(own) > leaf_rows * share:
            roots[name] = len(left)
            todo.append((len(left), own))
            left.append(-1), feature.append(0), cut.append(0.0)
    while todo:
        node, own = todo.pop()
        if len(own) <= leaf_rows * share:
            continue
        low, high = x[own].min(0), x[own].max(0)
        f = int(np.argmax(high - low))
        if high[f] <= low[f]:
            crowded.append(node)
            continue
        v = x[own, f]
        middle = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
        at = middle if middle < high[f] else low[f] + (high[f] - low[f]) / 2
        if not low[f] <= at < high[f]:  # no number lies between
            at = low[f]
        left[node], feature[node], cut[node] = len(left), f, at
        for side in (own[v <= at], own[v > at]):
            todo.append((len(left), side))
            left.append(-1), feature.append(0), cut.append(0.0)
    d = x.shape[1]
    return Splits(roots, np.array(left, np.int64), np.array(feature, np.int64), np.array(cut, float), np.full((len(left), d), np.inf), np.full((len(left), d), -np.inf)), crowded


def _same(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the rows: a row of each place, each row's place, and its number among those of its place, in their order."""
    order = np.lexsort(x.T)
    new = np.ones(len(x), bool)
    new[1:] = (x[order][1:] != x[order][:-1]).any(1)
    place, number = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    number[order] = np.arange(len(x)) - np.flatnonzero(new)[place[order]]
    return order[new], place, number


def _cells(x: np.ndarray, size: int) -> list[np.ndarray]:
    """The rows in cells of at most `size`, cut in halves along the feature of largest spread."""
    cells, todo = [], [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= size:
            cells.append(own)
            continue
        f, half = np.argmax(np.ptp(x[own], axis=0)), len(own) // 2
        own = own[np.argpartition(x[own, f], half)]
        todo += [own[:half], own[half:]]
    return cells


def _nearest(asked: np.ndarray, reach: np.ndarray | None, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, distance, row): the k rows nearest to each query, in order, the first on ties; those within `reach` where it is known, else all.

    The nearest cell of a query bounds the distance of the k-th; then it meets the cells that are as near.
    """
    if not len(x):
        return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
    cells = _cells(x, max(CELL_ROWS, 2 * k))
    box = np.zeros((len(asked), len(cells)))
    for f in range(x.shape[1]):
        low, high = (np.array([pick(x[own, f]) for own in cells]) for pick in (np.min, np.max))
        box += np.maximum(np.maximum(low - asked[:, f, None], asked[:, f, None] - high), 0) ** 2
    box = np.sqrt(box)

    def far(q: np.ndarray, own: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), len(own)))
        for f in range(x.shape[1]):
            gap = asked[q, f, None] - x[own, f]
            gap *= gap
            out += gap
        return out

    def steps(q: np.ndarray, own: np.ndarray) -> Iterator[np.ndarray]:
        n = max(1, STEP_PAIRS // len(own))
        return (q[at : at + n] for at in range(0, len(q), n))

    if reach is None:
        reach, home = np.full(len(asked), np.inf), box.argmin(1)
        for c, own in enumerate(cells):
            for q in steps(np.flatnonzero(home == c), own) if len(own) >= k else ():
                reach[q] = np.round(np.sqrt(np.partition(far(q, own), k - 1, axis=1)[:, k - 1]), 9)
    near = box <= reach[:, None] + 1e-8
    parts = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
    for c, own in enumerate(cells):
        for q in steps(np.flatnonzero(near[:, c]), own):
            square = far(q, own)
            a, b = np.nonzero(square <= (reach[q, None] + 1e-8) ** 2)
            d = np.round(np.sqrt(square[a, b]), 9)
            kept = d <= reach[q[a]]
            parts.append((q[a[kept]], d[kept], own[b[kept]]))
    a, d, b = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((b, d, a))
    a, d, b = a[order], d[order], b[order]
    kept = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[kept], d[kept], b[kept]


#: What a leaf gives a query, in order.
FOUND = "array<struct<distance: double, neighbour: long, other: long>>"


def _found(asked: pa.Table, rows: pa.Table, xs: list[str], k: int) -> tuple[np.ndarray, pa.Array]:
    """The queries' order by leaf, and for each in this order its k nearest rows of its leaf, those within `_r` where the queries have it.

    Queries of one place share a search, for one row more than k, as each leaves out itself; of the rows of one place
    only so many can be neighbours.
    """
    of = lambda t, c, order: t.column(c).to_numpy()[order]
    by_leaf = np.argsort(asked.column("_leaf").to_numpy(), kind="stable")
    q_leaf, own, places = of(asked, "_leaf", by_leaf), of(asked, "_id", by_leaf), np.column_stack([of(asked, c, by_leaf) for c in xs])
    known = of(asked, "_r", by_leaf) if "_r" in asked.column_names else None
    order = np.lexsort((rows.column("_id").to_numpy(), rows.column("_leaf").to_numpy()))
    r_leaf, ids, labels, x = of(rows, "_leaf", order), of(rows, "_id", order), of(rows, "_y", order), np.column_stack([of(rows, c, order) for c in xs])
    lengths, parts = [np.zeros(1, np.int64)], [(np.empty(0), np.empty(0, np.int64))]
    for leaf in np.unique(q_leaf).tolist():
        mine, there = (slice(*np.searchsorted(v, (leaf, leaf + 1)).tolist()) for v in (q_leaf, r_leaf))
        one, place, _ = _same(places[mine])
        reach = None
        if known is not None:
            reach = np.zeros(len(one))
            np.maximum.at(reach, place, known[mine])
        kept = np.flatnonzero(_same(x[there])[2] <= k) + there.start  # rows are in the order of their ids
        a, d, b = _nearest(places[mine][one], reach, x[kept], k + 1)
        start = np.searchsorted(a, np.arange(len(one) + 1))
        n = np.diff(start)[place]
        q = np.repeat(np.arange(len(place)), n)
        at = np.arange(len(q)) + np.repeat(start[place] - np.cumsum(n) + n, n)
        other = ids[kept[b[at]]] != own[mine][q]
        q, at = q[other], at[other]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        lengths.append(np.bincount(q[first], minlength=len(place)))
        parts.append((d[at[first]], kept[b[at[first]]]))
    d, b = (np.concatenate(c) for c in zip(*parts))
    row = pa.StructArray.from_arrays([pa.array(d), pa.array(ids[b], pa.int64()), pa.array(labels[b], pa.int64())], ["distance", "neighbour", "other"])
    return by_leaf, pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(lengths)), pa.int32()), row)


def _search(asked: DataFrame, rows: DataFrame, features: int, k: int, per_label: bool, leaf_rows: int, n_asked: int, n_rows: int, report: dict | None = None) -> DataFrame:
    """`asked` with `_found`, in order, by the leaves of k-d trees, one tree for each large group (and label, with `per_label`).

    The trees are split by a sample of about SAMPLE rows and SAMPLE_LEAF a leaf; all rows are then dealt to the leaves
    and give them their exact bounds, so the sample decides nothing but the sizes. Each query first gets the k nearest of
    its own leaf (of all labels), then visits the other leaves whose bounds lie within the distance of the k-th: the
    result is exact. Such a query lies outside of the leaf's bounds, so it meets only the rows that are as near to one of
    these bounds as the leaf's queries reach. Of more than `leaf_rows` rows in one place only k + 1 can be neighbours, so
    that no leaf grows with repeated places, and the queries of a leaf are dealt to several tasks.

    A query has one row. With `per_label` it searches the rows of its `_label`; where it has none it searches all labels
    and has several rows, which are to be ranked.
    """
    ranked = per_label and "_label" not in asked.columns
    xs = [f"_x{f}" for f in range(features)]
    part = (lambda label: F.concat("_by", F.lit("|"), label)) if per_label else (lambda label: F.col("_by"))
    rows = rows.withColumn("_part", part(F.col("_y")))
    share = min(1.0, max(SAMPLE_LEAF / leaf_rows, SAMPLE / max(n_rows, 1)))
    some = rows.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("_part", *xs).toArrow().to_pandas()  # share of all rows
    tree, crowded = splits_of(some["_part"].to_numpy(object).astype(str), some[xs].to_numpy(float), share, leaf_rows)
    x_of = lambda v: np.column_stack([c.to_numpy(float) for c in v])
    leaf = F.pandas_udf(lambda p, *v: pd.Series(tree.leaf_of(p, x_of(v))), "long")
    lone = F.when(F.col("_leaf") < 0, F.col("_part")).otherwise("")  # a part without a tree is a leaf of its own
    dealt = rows.withColumn("_leaf", leaf("_part", *xs))
    if crowded:
        place = F.row_number().over(Window.partitionBy("_part", *xs).orderBy("_id"))
        full = F.col("_leaf").isin(crowded)
        dealt = dealt.where(~full).unionByName(dealt.where(full).withColumn("_k", place).where(F.col("_k") <= k + 1).drop("_k"))
    dealt = written(dealt.select("_id", "_y", "_leaf", lone.alias("_lone"), *xs))
    bounds = dealt.where("_leaf >= 0").groupBy("_leaf").agg(*(f(c) for f in (F.min, F.max) for c in xs)).toArrow().to_pandas().to_numpy(float).reshape(-1, 1 + 2 * features)  # a row for each leaf
    tree.bounded(bounds[:, 0].astype(np.int64), bounds[:, 1 : 1 + features], bounds[:, 1 + features :])
    if ranked:
        labels = [r[0] for r in rows.select("_y").distinct().orderBy("_y").collect()]  # the classes
        asked = asked.withColumn("_label", F.explode(F.array(*map(F.lit, labels)).cast("array<long>")))
    asked = asked.withColumn("_part", part(F.col("_label")) if per_label else part(None))

    def others(parts: pd.Series, own: np.ndarray, reach: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaves within reach but the row's own: where each row's begin and end, and the leaves."""
        row, leaf = tree.within(parts, x, reach + 1e-8)
        other = leaf != own[row]
        row, leaf = row[other], leaf[other]
        order = np.argsort(row, kind="stable")
        return np.searchsorted(row[order], np.arange(len(own) + 1)), leaf[order]

    def meet(queries: DataFrame, blocks: DataFrame, rows: DataFrame, at: list[str], onward: bool) -> DataFrame:
        """The queries with what they find among the rows of their leaf and the distance of the k-th (else infinite), `onward` also the other leaves within it; a leaf's rows are sent to each block of its queries. `at` is the leaf, then what else tells it."""
        to = F.broadcast(blocks.select(*at, "_blocks"))  # a row for each leaf
        own, some_leaves = queries.columns, F.shiftright("_leaf", LEAF_BITS).alias("_bin")
        left = queries.join(to, at).select(*own, some_leaves, F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int").alias("_block"))
        right = rows.select(*at, "_id", "_y", *xs, some_leaves, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))

        def run(q: pa.Table, r: pa.Table) -> pa.Table:
            order, found = _found(q, r, xs, k)
            start, end, far = found.offsets.to_numpy()[:-1], found.offsets.to_numpy()[1:], found.values.field(0).to_numpy()
            kth = np.full(len(order), np.inf)
            kth[end - start >= k] = far[start[end - start >= k] + k - 1]
            out = q.select(own).take(pa.array(order)).append_column("_kth", pa.array(kth)).append_column("_found", found)
            if not onward:
                return out
            first, leaves = others(out.column("_part").to_pandas(), out.column("_leaf").to_numpy(), kth, np.column_stack([out.column(c).to_numpy() for c in xs]))
            return out.append_column("_to", pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(leaves, pa.int64())))

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema) + f", _kth double, _found {FOUND}" + (", _to array<long>" if onward else "")
        met = ["_bin", *at[1:], "_block"]
        return left.groupBy(*met).cogroup(right.groupBy(*met)).applyInArrow(run, schema)

    n_blocks = F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_blocks")
    at, more = ["_leaf", "_lone"], ["_label"] if per_label else []
    names = ["_id", "_y", "_by", *xs, *more]
    placed = written(asked.withColumn("_leaf", leaf("_part", *xs)).select(*names, "_part", "_leaf", lone.alias("_lone")))
    blocks = placed.groupBy(*at).agg(n_blocks)
    first = written(meet(placed, blocks, dealt.join(F.broadcast(blocks), at), at, not ranked).drop("_lone"))  # a row for each leaf
    if ranked:
        near = lambda of, n: F.coalesce(F.get(of, F.lit(n)), F.lit(float("inf")))
        kth = first.groupBy("_id").agg(near(F.array_sort(F.flatten(F.collect_list("_found.distance"))), k - 1).alias("_r"))

        def leaves(p: pd.Series, own: pd.Series, r: pd.Series, *v: pd.Series) -> pd.Series:
            start, leaf = others(p, own.to_numpy(), r.to_numpy(float), x_of(v))
            return pd.Series(np.split(leaf, start[1:-1]))

        wide = first.join(kth, "_id").withColumn("_r", F.greatest("_r", near(F.col("_found.distance"), 0)))
        wide = wide.withColumn("_to", F.pandas_udf(leaves, "array<long>")("_part", "_leaf", "_r", *xs))
    else:
        wide = first.withColumn("_r", F.col("_kth"))
    visits = written(wide.select(*names, "_r", F.explode("_to").alias("_leaf")))
    if report is not None:
        report |= {"leaves": int(((tree.left < 0) & (tree.low <= tree.high).all(1)).sum()), "visits": (first.count() + visits.count()) / max(n_asked, 1)}
    low, high = (F.pandas_udf(lambda n, b=b: pd.Series(list(b[n.to_numpy()])), "array<double>") for b in (tree.low, tree.high))
    blocks = visits.groupBy("_leaf").agg(n_blocks, F.max("_r").alias("_far")).withColumns({"_low": low("_leaf"), "_high": high("_leaf")})
    edge = F.least(*(gap for f, c in enumerate(xs) for gap in (F.col(c) - F.col("_low")[f], F.col("_high")[f] - F.col(c))))
    second = meet(visits, blocks, dealt.join(F.broadcast(blocks), "_leaf").where(edge <= F.col("_far") + 1e-8), ["_leaf"], False)  # a row for each leaf
    if ranked:
        return first.select(*names, "_found").unionByName(second.select(*names, "_found"))
    found = second.groupBy("_id", *more).agg(F.flatten(F.collect_list("_found")).alias("_more"))
    both = F.slice(F.array_sort(F.concat("_found", F.coalesce("_more", F.array().cast(FOUND)))), 1, k)
    alone = F.size("_to") == 0  # no other leaf is within reach
    return first.where(alone).select(*names, "_found").unionByName(first.where(~alone).join(found, ["_id", *more], "left").select(*names, both.alias("_found")))


def standardized(df: DataFrame, features: list[str], places: int = 6) -> DataFrame:
    """`features` as z-scores (population deviation, constant: 0), rounded; the row of statistics is broadcast."""
    stats = df.agg(*(F.avg(f).alias(f"{f}__m") for f in features), *(F.stddev_pop(f).alias(f"{f}__s") for f in features))
    z = {f: F.round(F.when(F.col(f"{f}__s") > 0, (F.col(f) - F.col(f"{f}__m")) / F.col(f"{f}__s")).otherwise(0.0), places) for f in features}
    return df.crossJoin(F.broadcast(stats)).withColumns(z).select(*df.columns)  # one row


def _count(k: int, which: Callable[[Column], Column]) -> Column:
    """How many of the k nearest in a list are so."""
    return F.size(F.filter(F.slice("found", 1, k), which))


def consistency(neighbours: DataFrame, key: str, k: int) -> DataFrame:
    """(key, consistency): share of the k nearest with the query's own label; queries with fewer than k neighbours still divide by k."""
    return neighbours.where(F.col("rank") <= k).groupBy(key).agg((F.count_if(F.col("own") == F.col("other")) / k).alias("consistency"))


def list_consistency(lists: DataFrame, key: str, k: int) -> DataFrame:
    """`consistency` from lists of neighbours."""
    return lists.select(key, (_count(k, lambda r: r["other"] == F.col("own")) / k).alias("consistency"))


def reach_quantiles(lists: DataFrame, k: int, qs: list[float]) -> DataFrame:
    """(q): exact quantiles of the distance to the k-th neighbour, from lists of neighbours."""
    return quantiles(written(lists.select(F.get("found", F.lit(k - 1))["distance"].alias("distance"))), [], "distance", qs)


def consistency_by_cut(df: DataFrame, key: str, features: list[str], value: str, cuts: dict[str, float], asked: Column, k: int, name: str) -> DataFrame:
    """(`name`, key, consistency) of several predictions, each of which is whether `value` is at least a cut: neighbours are searched once, with all predictions as the bits of one label."""
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft((F.col(value) >= least).cast("long"), n) for n, least in enumerate(cuts.values())))
    rows = standardized(df.withColumn("_bits", bits), features)
    near = knn_join(rows.where(asked), rows, key, features, k, "_bits")
    bit = lambda c, n: F.shiftright(c, n).bitwiseAND(F.lit(1))
    each = F.array(*(F.struct(F.lit(c).alias(name), bit("own", n).alias("_own"), bit("other", n).alias("_other")) for n, c in enumerate(cuts)))
    t = near.select(key, F.inline(each))
    return t.groupBy(name, key).agg((F.count_if(F.col("_own") == F.col("_other")) / k).alias("consistency"))


def consistency_summary(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    c = F.col("consistency")
    return df.groupBy(*keys).agg(F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("std"), F.min(c).alias("min"), F.median(c).alias("median"), F.count("*").alias("n"))


def consistency_multi_k(neighbours: DataFrame, key: str, ks: list[int]) -> DataFrame:
    """The summary for each of `ks`, from one join at the largest."""
    t = neighbours.select(key, "rank", "own", "other", F.explode(F.array(*map(F.lit, ks))).alias("k")).where("rank <= k")
    per = t.groupBy("k", key).agg((F.count_if(F.col("own") == F.col("other")) / F.col("k")).alias("consistency"))
    return consistency_summary(per, ["k"])


def _over_classes(per_class: DataFrame, value: Column, name: str) -> DataFrame:
    """The mean over two classes; null where one is missing."""
    return per_class.agg(F.round(F.when(F.count("*") == 2, F.avg(value)), 6).alias(name))


def n3(neighbours: DataFrame) -> DataFrame:
    """Error of the nearest neighbour, by class, averaged."""
    t = neighbours.where("rank = 1").groupBy("own").agg(F.avg((F.col("own") != F.col("other")).cast("int")).alias("e"))
    return _over_classes(t, F.col("e"), "n3")


def n2(queries: DataFrame, rows: DataFrame, key: str, features: list[str], label: str, k: int = 5) -> DataFrame:
    """Nearest distances within a class against those to the other, r / (1 + r), averaged over the classes. Most queries see both classes among their k nearest."""
    t = knn_labels(queries, rows.where(F.col(label).isin(0, 1)), key, features, k, label)
    r = t.groupBy("own").agg((F.sum("within") / (F.sum("across") + 1e-12)).alias("r"))
    return _over_classes(r, F.col("r") / (1 + F.col("r")), "n2")


def raug(lists: DataFrame, k: int = 5, delta: int = 2) -> DataFrame:
    """Share of each class with more than `delta` of its k nearest in the other, and their weighted count; from lists of neighbours."""
    per = lists.select("own", (_count(k, lambda r: r["other"] != F.col("own")) > delta).cast("long").alias("hit"))
    t = per.agg(*(f(F.col("own") == c).alias(f"n{c}") for c, f in ((0, F.count_if), (1, F.count_if))), *(F.count_if((F.col("own") == c) & (F.col("hit") == 1)).alias(f"h{c}") for c in (0, 1)))
    ir = F.col("n0") / F.greatest("n1", F.lit(1))
    return t.select(F.round(F.col("h0") / F.greatest("n0", F.lit(1)), 6).alias("majority"), F.round(F.col("h1") / F.greatest("n1", F.lit(1)), 6).alias("minority"), F.round((F.col("h0") + ir * F.col("h1")) / (ir + 1), 6).alias("weighted"))
