"""Measures over neighbours ask for all rows, not for a part of them."""

import numpy as np
import pandas as pd
import pytest

from equilens.operators import clustering
from equilens.operators import complexity as X
from equilens.operators import neighbours as N
from equilens.operators.places import parts_of
from equilens.plans import registry
from equilens.sources.tables import view

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def far(spark):
    """Rounded distances of all rows of v_knn at sf0.001, infinite to itself, and the rows in the order of their keys."""
    t = N.standardized(view(spark, DATA, "v_knn"), ["f1", "f2"]).toPandas().sort_values("row_id").reset_index(drop=True)
    x = t[["f1", "f2"]].to_numpy()
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    np.fill_diagonal(d, np.inf)
    return t, d, np.argsort(d, axis=1, kind="stable")


def _run(spark, name):
    return registry.queries()[name](spark, DATA).toPandas()


def _over_classes(values, of):
    return round(np.mean([values[of == c].mean() for c in (0, 1)]), 6)


def test_consistency_of_all_rows(spark, far):
    t, _, order = far
    y = t["y_pred"].to_numpy()
    want = (y[order[:, :5]] == y[:, None]).mean(1)
    got = _run(spark, "knn_consistency").iloc[0]
    assert got["n"] == len(t) and got["mean"] == pytest.approx(want.mean(), abs=1e-6)
    assert "% 50" not in registry.oracle_sql()["knn_consistency"]


@pytest.mark.parametrize("labels", [False, True])
def test_lists_of_all_rows_by_partitions(spark, monkeypatch, labels):
    # places are repeated, one of them 400 times, and labels lie apart; in one group there is one label only
    r = np.random.default_rng(8)
    x, u = np.round(r.normal(size=1200) * 4, 1), np.round(r.normal(size=1200), 1)
    x[::3], u[::3] = 0.5, 0.5
    rows = [(i, int(x[i] > 2) if i % 2 else 1, "ab"[i % 2], float(x[i]), float(u[i])) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, y int, g string, x double, u double")
    p = df.toPandas()
    monkeypatch.setattr(N, "SCAN_QUERIES", 0)
    monkeypatch.setattr(N, "LEAF_ROWS", 150)
    find = N.knn_labels if labels else N.knn_lists
    got = {q.id: q for q in find(df, df, "id", ["x", "u"], 4, "y", by="g").collect()}
    assert sorted(got) == list(range(1200))
    for i in range(0, 1200, 7):
        own = p[(p.g == p.g[i]) & (p.id != i)]
        d = np.round(np.sqrt((own.x - p.x[i]) ** 2 + (own.u - p.u[i]) ** 2), 9)
        near = pd.DataFrame({"d": d, "id": own.id, "y": own.y}).sort_values(["d", "id"])
        assert [tuple(n) for n in got[i].found] == list(near.head(4).itertuples(index=False, name=None))
        if labels:
            other = near[near.y != p.y[i]]
            assert got[i].within == near[near.y == p.y[i]].d.iloc[0]
            assert (got[i].across, got[i].across_key) == ((other.d.iloc[0], other.id.iloc[0]) if len(other) else (None, None))


def test_n3_of_all_rows(spark, far):
    t, _, order = far
    y = t["target"].to_numpy()
    assert _run(spark, "cx_n3").iloc[0, 0] == pytest.approx(_over_classes(y[order[:, 0]] != y, y), abs=1e-6)
    assert "% 50" not in registry.oracle_sql()["cx_n3"]


def test_raug_of_all_rows(spark, far):
    t, _, order = far
    y = t["target"].to_numpy()
    hit, n = (y[order[:, :5]] != y[:, None]).sum(1) > 2, [(y == c).sum() for c in (0, 1)]
    got = _run(spark, "cx_raug").iloc[0]
    assert (got["majority"], got["minority"]) == pytest.approx(tuple(hit[y == c].mean() for c in (0, 1)), abs=1e-6)
    assert got["weighted"] == pytest.approx((hit[y == 0].sum() + n[0] / n[1] * hit[y == 1].sum()) / (n[0] / n[1] + 1), abs=1e-5)
    assert "% 50" not in registry.oracle_sql()["cx_raug"]


def test_n2_of_all_rows(spark, far):
    t, d, _ = far
    y = t["target"].to_numpy()
    near = [np.where(y == c, d, np.inf).min(1) for c in (0, 1)]
    r = [near[c][y == c].sum() / (near[1 - c][y == c].sum() + 1e-12) for c in (0, 1)]
    assert _run(spark, "cx_n2").iloc[0, 0] == pytest.approx(np.mean([v / (1 + v) for v in r]), abs=1e-6)
    assert "% 50" not in registry.oracle_sql()["cx_n2"]


def test_eps_grid_of_all_rows(spark, far):
    _, d, order = far
    fifth = np.take_along_axis(d, order[:, 4:5], 1)[:, 0]
    assert list(_run(spark, "cluster_eps_grid").iloc[0]) == pytest.approx(np.quantile(fifth, (0.25, 0.5, 0.75)).tolist(), abs=1e-6)
    assert "% 50" not in registry.oracle_sql()["cluster_eps_grid"]


GROUPS = {"complexity_by_group": ("grp", lambda v: v["segment"].where(v["f2"] >= -980, "DEBT")), "complexity_intersection": ("cell", lambda v: "segment=" + v["segment"] + "|debtor=" + (v["f2"] < 0).map({True: "yes", False: "no"}))}


@pytest.mark.parametrize("name", sorted(GROUPS))
def test_complexity_by_group_of_all_rows(spark, far, name):
    t, d, _ = far
    by, group = GROUPS[name]
    of = group(view(spark, DATA, "v_knn").toPandas().sort_values("row_id").reset_index(drop=True))
    got = _run(spark, name)
    got = got[got["metric"] == "N3"].set_index(by)["value"]
    assert set(got.index) == set(of.value_counts()[lambda n: n >= 50].index)
    for g, value in got.items():
        own = np.flatnonzero(of == g)
        y = t["target"].to_numpy()[own]
        assert value == pytest.approx(_over_classes(y[d[np.ix_(own, own)].argmin(1)] != y, y), abs=1e-6)
    assert "% 50" not in registry.oracle_sql()[name]


def _bayes(x, y, key):
    """Mean gap over all rows of class 1, by all pairs."""
    gaps, ratio, depth = [], (y == 0).sum() / (y == 1).sum(), min(100, len(y) - 1)
    for i in np.flatnonzero(y == 1):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 9)
        near = y[[j for j in np.lexsort((key, d)) if j != i][: depth - 1]]
        m, size = int((near[:5] == 1).sum()), 5
        if m == 5:
            m = int(np.argmax(near == 0)) - 1 if (near == 0).any() else depth
            size = m + 1
        own, other = m / size, (size - m) / size
        gaps.append(ratio * other / (ratio * other + own + 1e-12) - other / (other + own + 1e-12))
    return np.mean(gaps)


@pytest.mark.parametrize("scan", [True, False])
def test_bayes_imbalance_of_repeated_places(spark, monkeypatch, scan):
    # a place has rows of both classes, in any order of their keys; class 1 of one group lies apart
    r = np.random.default_rng(5)
    x = np.round(np.column_stack([r.normal(size=600) * 2, r.normal(size=600)]), 0)
    y = (r.random(600) < 0.85).astype(int)
    g = np.arange(600) % 2
    y[g == 1] = x[g == 1, 0] > 0
    df = spark.createDataFrame([(i, int(y[i]), "ab"[g[i]], *map(float, x[i])) for i in range(600)], "id long, y int, g string, x double, u double")
    if not scan:
        monkeypatch.setattr(N, "SCAN_QUERIES", 0)
        monkeypatch.setattr(N, "LEAF_ROWS", 60)
    got = {q.g: q.value for q in X.neighbourhood(df, "id", "g", ["x", "u"], "y").where("metric = 'BayesImbalance'").collect()}
    for c in (0, 1):
        own = np.flatnonzero(g == c)
        assert got["ab"[c]] == pytest.approx(_bayes(x[own], y[own], own), abs=1e-6)


def test_fits_of_clusters_take_few_tasks_over_places_as_they_are(spark, monkeypatch):
    # a persisted table would be turned into vectors again in every pass
    levels, fit = [], clustering.KMeans.fit
    monkeypatch.setattr(clustering.KMeans, "fit", lambda self, data: levels.append(data.storageLevel) or fit(self, data))
    monkeypatch.setitem(clustering.MODELS, "kmeans", clustering.KMeans)
    clustering.candidates(N.standardized(view(spark, DATA, "v_knn"), ["f1", "f2"]), ["f1", "f2"], "kmeans", (2, 3))
    assert len(levels) == 2 and not any(level.useMemory for level in levels)
    assert [parts_of(n, 100_000) for n in (0, 15_000, 150_000, 1_500_000, 9_000_000, 54_000_000)] == [1, 2, 15, 16, 90, 200]


def test_complexity_all_of_all_rows(spark, far):
    t, d, order = far
    y = t["target"].to_numpy()
    got = _run(spark, "complexity_all").set_index("metric")["value"]
    assert got["N3"] == pytest.approx(_over_classes(y[order[:, 0]] != y, y), abs=1e-6)
    near = [np.where(y == c, d, np.inf).min(1) for c in (0, 1)]
    r = [near[c][y == c].sum() / near[1 - c][y == c].sum() for c in (0, 1)]
    assert got["N2"] == pytest.approx(np.mean([v / (1 + v) for v in r]), abs=1e-6)
    hit, n = (y[order[:, :5]] != y[:, None]).sum(1) > 2, [(y == c).sum() for c in (0, 1)]
    assert got["Raug"] == pytest.approx((hit[y == 0].sum() + n[0] / n[1] * hit[y == 1].sum()) / (n[0] / n[1] + 1), abs=1e-5)
    assert got["BayesImbalance"] == pytest.approx(_bayes(t[["f1", "f2"]].to_numpy(), y, t["row_id"].to_numpy()), abs=1e-6)
