"""Natural breaks against all divisions of small groups."""

from itertools import combinations

import numpy as np
import pytest

from equilens.operators import breaks as K


def test_natural_breaks_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(x)) for g in range(12) for x in np.round(rng.normal(0, 90, 14 + g), 2).tolist() * 2 + [0.25] * g]
    got = {r.g: r.edges for r in K.jenks_edges(spark.createDataFrame(rows, "g int, x double"), ["g"], "x", 4).collect()}

    def spread(x, edges):
        bins = np.searchsorted(edges[1:-1], x, side="left")
        return sum(((x[bins == b] - x[bins == b].mean()) ** 2).sum() for b in set(bins.tolist()))

    for g in range(12):
        x = np.array([v for k, v in rows if k == g])
        values = np.unique(x)
        least = min(spread(x, [0, *inner, 0]) for inner in combinations(values[:-1].tolist(), 3))
        e = got[g]
        assert (e[0], e[-1]) == (x.min() - 0.001, x.max() + 0.001) and len(e) == 5 and abs(spread(x, e) - least) < 1e-6


def spread_of(x, edges):
    at = np.searchsorted(edges[1:-1], x, side="left")
    return sum(((x[at == b] - x[at == b].mean()) ** 2).sum() for b in set(at.tolist()))


@pytest.mark.parametrize("classes, block, fan", [(4, 16, 2), (3, 25, 32), (2, 16, 2), (1, 16, 2)])
def test_natural_breaks_by_blocks(spark, classes, block, fan):
    """Groups of many blocks have the divisions that one task finds; a null group, repeats and values that don't count among them."""
    rng = np.random.default_rng(classes)
    groups = {
        "normal": rng.normal(0, 90, 230), "skewed": np.round(rng.exponential(5, 600), 1), "jump": np.concatenate([np.arange(150) / 1e3, 1e4 + np.arange(200)]),
        None: np.repeat(rng.integers(-200, 200, 150), 3).astype(float), "few": np.array([1.0, 2.0, 2.0, 9.0]), "one": np.array([7.0, 7.0]), "block": np.arange(float(block)),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("few", None), ("few", float("nan")), ("one", float("inf")), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, value double")
    got = {r.g: r.edges for r in K.jenks_edges(df, ["g"], "value", classes, block, fan, slice_rows=70).collect()}
    assert got.keys() == groups.keys()
    for g, x in groups.items():
        v, n = np.unique(x, return_counts=True)
        want = K.natural_breaks(v, n.astype(float), classes)
        e = got[g]
        assert (e[0], e[-1]) == (v[0] - 0.001, v[-1] + 0.001) and len(e) == 1 + min(classes, len(v)) and e == sorted(e)
        assert np.isclose(spread_of(x, e), spread_of(x, want), rtol=1e-9, atol=1e-6)
    empty = K.jenks_edges(df.limit(0), ["g"], "value", classes, block, fan)
    assert empty.columns == ["g", "edges"] and empty.count() == 0


def test_no_task_of_the_natural_breaks_holds_a_group(spark, monkeypatch):
    """What meets in one call of the search is two blocks, or the ends of blocks and one block, however large the group."""
    seen = []
    met = K._cuts

    def counted(points, level, on, first):
        sizes = [t.groupBy(*on).count().agg({"count": "max"}).first()[0] for t in (points, level)]
        seen.append(sizes)
        return met(points, level, on, first)

    monkeypatch.setattr(K, "_cuts", counted)
    df = spark.range(2500).selectExpr("id * id % 7919 / 7D AS value")
    values = df.distinct().count()
    (row,) = K.jenks_edges(df, [], "value", 4, 100, 4).collect()
    v, n = np.unique([r.value for r in df.collect()], return_counts=True)
    want = K.natural_breaks(v, n.astype(float), 4)
    assert len(row.edges) == 5 and np.allclose(row.edges[1:-1], want[1:-1])
    assert values > 2000 and seen and max(max(s) for s in seen) <= 100
