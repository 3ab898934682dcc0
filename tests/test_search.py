"""Density clusters, searches, chained mitigations, and files, on small tables with a known answer."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from equilens.operators import clustering, density, graph, harmonize, preparation, search, statistics, subgroups
from equilens.operators import models as M
from equilens.sources import files, tables


@pytest.fixture(scope="module")
def checkpoints(spark, tmp_path_factory):
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


@pytest.fixture(scope="module")
def biased(spark):
    r = np.random.default_rng(0)
    rows = []
    for i in range(600):
        g = i % 2
        x = float(r.normal(1.5 * g, 1))
        rows.append((i, x, None if i % 50 == 0 else float(r.normal()), "ab"[g], int(x + r.normal(0, 0.5) > 0.75)))
    return spark.createDataFrame(rows, "id long, x double, u double, g string, y int").cache()


def dbscan_by_brute_force(points, eps, least):
    d = np.round(np.sqrt(((points[:, None] - points[None]) ** 2).sum(2)), 9)
    core = (d <= eps).sum(1) >= least
    label = np.where(core, np.arange(len(points)), -1)
    while True:
        new = label.copy()
        for i in np.flatnonzero(core):
            new[i] = label[core & (d[i] <= eps)].min()
        if (new == label).all():
            break
        label = new
    for i in np.flatnonzero(~core):
        near = np.flatnonzero(core & (d[i] <= eps))
        if len(near):
            label[i] = label[min(near, key=lambda j: (d[i, j], j))]
    return label


@pytest.mark.parametrize("eps, least", [(0.3, 4), (0.8, 8), (0.05, 3)])
def test_dbscan(spark, checkpoints, eps, least):
    r = np.random.default_rng(int(eps * 100))
    points = np.concatenate([r.normal((0, 0), 0.3, (80, 2)), r.normal((3, 1), 0.4, (80, 2)), r.uniform(-2, 5, (40, 2)), np.zeros((5, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id long, x double, y double")
    got = {r.id: r.cluster for r in density.dbscan(df, "id", ["x", "y"], eps, least).collect()}
    want = dbscan_by_brute_force(points, eps, least)
    same = {}
    for i, c in enumerate(want):  # clusters have the same members and noise is the same
        assert (c == -1) == (got[i] == -1) and same.setdefault(int(c), got[i]) == got[i]
    assert len(set(same.values())) == len(same)
    assert density.dbscan(df.limit(0), "id", ["x", "y"], eps, least).count() == 0


@pytest.mark.parametrize("gap, linked", [(0.2999, True), (0.3001, False)])
def test_dense_cells_are_linked_by_their_closest_rows(spark, checkpoints, monkeypatch, gap, linked):
    # two dense cells whose outermost rows along each feature are far apart, and a bridge from one corner to the other
    r = np.random.default_rng(1)
    a = r.uniform(0, 0.05, (3000, 2))
    b = r.uniform(0, 0.05, (3000, 2)) + [0.45, 0.0]
    bridge = np.array([[0.06, 0.03], [0.06 + gap, 0.03]])
    points = np.concatenate([a, b, bridge, [[0.04, 0.21], [0.36, 0.21], [0.04, -0.15], [0.36, -0.15]]])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id long, x double, y double")
    monkeypatch.setattr(density, "SMALL", 50)
    got = {r.id: r.cluster for r in density.dbscan(df, "id", ["x", "y"], 0.3, 50).collect()}
    want = dbscan_by_brute_force(points, 0.3, 50)
    same = {}
    for i, c in enumerate(want):
        assert (c == -1) == (got[i] == -1) and same.setdefault(int(c), got[i]) == got[i]
    assert (got[0] == got[3000]) == linked and len(set(same.values())) == len(same)


def test_large_dense_cells_finish(spark, checkpoints):
    # 200 000 rows in two cells, nearly out of reach of each other
    df = spark.range(200_000).select("id", ((F.col("id") % 2) * 0.26 + F.rand(3) * 0.02).alias("x"), (F.rand(4) * 0.02).alias("y")).where("(id % 2 = 0) = (x < 0.1)")
    t = density.dbscan(df, "id", ["x", "y"], 0.25, 10).groupBy("cluster").count().collect()
    assert sum(r["count"] for r in t) == 200_000 and len(t) == 1
    far = density.dbscan(df.withColumn("x", F.col("x") * 1.2), "id", ["x", "y"], 0.25, 10).groupBy("cluster").count().collect()
    assert [r["count"] for r in far] == [100_000, 100_000]


def test_components(spark, checkpoints):
    r = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000, 1000 + i) for i in range(1, 300)] + [tuple(map(int, r.integers(2000, 2300, 2))) for _ in range(150)]
    nodes = spark.createDataFrame([(i,) for i in {x for e in edges for x in e} | {5000}], "id long")
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), nodes).collect()}
    root = {r.id: r.id for r in nodes.collect()}
    while True:
        new = dict(root)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            break
        root = new
    assert got == root


def test_density_grid(spark, checkpoints):
    r = np.random.default_rng(3)
    points = np.concatenate([r.normal((0, 0), 0.1, (150, 2)), r.normal((3, 3), 0.1, (150, 2)), r.uniform(-5, 8, (20, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id long, x double, y double")
    grid, best = density.dbscan_grid(df, "id", ["x", "y"], [0.01, 0.5, 20.0], [5])
    rows = {r.eps: r for r in grid.collect()}
    assert rows[0.5].chosen and rows[0.5].clusters == 2 and rows[0.5].note == "noise is a cluster" and rows[0.5].silhouette > 0.9
    assert not rows[0.01].chosen and rows[20.0].note == "fewer than two clusters"
    assert best.where("cluster <> -1").count() >= 300
    assert density.dbscan_grid(df, "id", ["x", "y"], [20.0], [5])[1] is None


def test_mixture_by_bic_and_gates(spark, checkpoints):
    r = np.random.default_rng(6)
    points = np.concatenate([r.multivariate_normal(m, c, 300) for m, c in (((0, 0), [[1, 0.8], [0.8, 1]]), ((6, 0), [[0.3, 0], [0, 2]]), ((0, 7), [[1, -0.5], [-0.5, 1]]))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id long, x double, y double").cache()
    found = {c.setting: c for c in clustering.gmm_candidates(df, ["x", "y"], (2, 3, 4))}
    assert min(found, key=lambda k: found[k].bic) == "k=3" and abs(found["k=3"].smallest - 300) < 10
    w, m, c = np.array([0.25, 0.75]), np.array([[0.0, 1.0], [2.0, 0.0]]), np.array([[[1, 0.3], [0.3, 2]], [[0.5, 0], [0, 0.7]]])
    pdf = lambda p, k: np.exp(-(p - m[k]) @ np.linalg.inv(c[k]) @ (p - m[k]) / 2) / (2 * np.pi * np.sqrt(np.linalg.det(c[k])))
    assert clustering.log_likelihood(df, ["x", "y"], w, m, c) == pytest.approx(sum(np.log(w[0] * pdf(p, 0) + w[1] * pdf(p, 1)) for p in points), rel=1e-9)
    assert clustering.free_parameters(3, 2) == 2 + 6 + 9
    told, rows = clustering.choose(df, ["x", "y"], ("kmeans", "gmm", "dbscan"), (2, 3), min_share=0.2, key="id", eps=(0.8,), least=(10,))
    told = {(t.method, t.setting): t for t in told.collect()}
    assert sum(t.chosen for t in told.values()) == 1 and told["gmm", "k=2"].reason == "higher BIC" and rows.groupBy("cluster").count().count() >= 2
    with pytest.raises(clustering.ClusteringError, match="no clustering is valid") as e:
        clustering.choose(df, ["x", "y"], ("kmeans",), (3,), min_size=400)
    assert e.value.diagnostics.first().reason == "a cluster is too small"
    with pytest.raises(clustering.ClusteringError) as e:
        clustering.choose(df, ["x", "y"], ("kmeans",), (3,), floor=0.999)
    assert e.value.diagnostics.first().reason == "silhouette below the floor"


def test_searches(biased):
    found = search.hpo_search(biased, "id", ["x", "u"], "y", {"c": [0.0001, 1.0]}).collect()
    assert [r.place for r in found] == [1, 2] and "1.0" in found[0].setting and found[0].f1 > 0.7
    full, features = biased.dropna().withColumn("gx", (F.col("g") == "b").cast("double")), ["x", "u", "gx"]
    for constraint, measure in (("demographic_parity", "dp_gap"), ("equalized_odds", "tpr_gap")):
        grid = search.grid_search(full, features, "y", "g", points=9, constraint=constraint).collect()
        assert len(grid) == 9 and sum(r.chosen for r in grid) == 1 and min(r[measure] for r in grid) < grid[0][measure] - 0.1
        assert [r.point for r in grid if r.chosen] == [min(grid, key=lambda r: (r.objective, r.point)).point]
        assert all(r.objective == pytest.approx((r.error + r.violation) / 2, abs=2e-6) for r in grid) and not grid[0].multipliers
    for d, n in ((1, 20), (2, 20), (4, 20), (8, 20), (3, 7), (0, 5)):
        points = search.lattice(d, n)
        assert len(set(points)) == len(points) == (n if d else 1) and not any(points[0])
        full_shells = [v for k in range(11) for v in itertools.product(range(-k, k + 1), repeat=d) if sum(map(abs, v)) == k] if d < 3 else []
        assert set(points) <= set(full_shells) or not full_shells
    train, test = full.where("id % 5 > 0"), full.where("id % 5 = 0")
    made = {(r.technique, r.attr): r for r in search.mit_matrix(train, test, "id", features, "y", ["g"], [[], ["reweight"], ["oversample", "thresholds"], ["thresholds", "reweight"]]).collect()}
    assert made["thresholds+reweight", "g"].error and made["oversample+thresholds", "g"].dp_gap < made["baseline", "g"].dp_gap
    plan = full.sparkSession.createDataFrame([("logistic", "baseline"), ("svm", "undersample")], "model string, mitigation string")
    assert {(r.model, r.mitigation, r.error) for r in search.sweep_run(train, test, "id", features, "y", "g", plan).collect()} == {("logistic", "baseline", None), ("svm", "undersample", None)}


def test_sweep_resumes(biased, checkpoints, tmp_path, monkeypatch):
    full, features = biased.withColumn("gx", (F.col("g") == "b").cast("double")), ["x", "u", "gx"]
    parts = full.dropna().where("id % 5 > 0"), full.dropna().where("id % 5 = 0")
    rows = [("a", m, method, "logistic") for m in ("baseline", "thresholds", "reweight") for method in ("holdout", "cv")] + [("a", "nonsense", "cv", "logistic"), ("lost", "baseline", "cv", "logistic"), ("a", "baseline", "holdout", "none")]
    plan = full.sparkSession.createDataFrame(rows, "dataset string, mitigation string, method string, model string")
    made, trained = [], search._trained
    monkeypatch.setattr(search, "_trained", lambda *a: made.append(a[-1]) or trained(*a))
    folder = str(tmp_path / "notes")
    some = search.sweep({("a", "none"): parts}, "id", features, "y", "g", plan.where("mitigation = 'baseline'"), 3, folder).collect()
    assert sorted((r.dataset, r.model, bool(r.error)) for r in some) == [("a", "logistic", False), ("a", "logistic", False), ("a", "none", True), ("lost", "logistic", True)]
    n = len(made)
    assert n == 1 + 3
    both = {(r.dataset, r.mitigation, r.method, r.model): r for r in search.sweep({("a", "none"): parts}, "id", features, "y", "g", plan, 3, folder).collect()}
    assert len(both) == len(rows) and "baseline" not in made[n:]  # only what was not noted was run
    assert both["a", "nonsense", "cv", "logistic"].error and both["a", "thresholds", "holdout", "logistic"].tpr_gap < both["a", "baseline", "holdout", "logistic"].tpr_gap
    again = len(made)
    assert search.sweep({("a", "none"): parts}, "id", features, "y", "g", plan, 3, folder).count() == len(rows) and len(made) == again
    # the folds' means by hand
    t = search.checkpointed(preparation.fold_preprocess(preparation.folds_stratified(parts[0].select("id", *features, "y", "g"), "id", ["y"], 3), features, "fold", 3))
    accuracy = [search.gaps(trained(t.where(f"fold_no = {k} AND side = 'train'"), t.where(f"fold_no = {k} AND side = 'test'"), "id", features, "y", "g", "logistic", "baseline"), "y", "g").first().accuracy for k in range(3)]
    assert both["a", "baseline", "cv", "logistic"].accuracy == pytest.approx(np.mean(accuracy), abs=1e-4)


def test_ranks_and_sums_in_slices(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("s"), F.when(F.col("id") % 10 > 0, (F.col("id") * 37 % 101).cast("double")).alias("v"))
    one = {r.id: (r._rank, r._n) for r in preparation.ranked(df, "id", ["s"]).collect()}
    assert {r.id: (r._rank, r._n) for r in preparation.ranked(df, "id", ["s"], slice_rows=50).collect()} == one
    counts = df.where("v IS NOT NULL").groupBy("s", "v").agg(F.count("*").alias("n"))
    whole = {(r.s, r.v): r.upto for r in statistics.running(counts, ["s"], "v", {"n": "upto"}).collect()}
    assert {(r.s, r.v): r.upto for r in statistics.running(counts, ["s"], "v", {"n": "upto"}, slice_rows=20).collect()} == whole
    got = {r.s: r.q for r in statistics.quantiles(df, ["s"], "v", [0.0, 0.3, 1.0]).collect()}
    want = {r.s: r.q for r in df.groupBy("s").agg(F.percentile("v", F.array(F.lit(0.0), F.lit(0.3), F.lit(1.0))).alias("q")).collect()}
    assert all(np.allclose(got[s], want[s]) for s in want)
    split = preparation.split_stratified(df.withColumn("rare", F.col("id").cast("string")), "id", ["s", "rare"])
    assert {r["count"] for r in split.groupBy("s", "split").count().where("split = 'test'").collect()} == {67}


def test_encoding_refuses_unseen_values(spark):
    train, test = (spark.createDataFrame([(v,) for v in x], "v string") for x in ("bca", "ad"))
    assert [r.v_code for r in preparation.encode_labels(train, train, "v")[1].orderBy("v").collect()] == [0, 1, 2]
    with pytest.raises(Exception, match="unseen value d"):
        preparation.encode_labels(train, test, "v")[1].collect()


def test_t1_by_hand(spark):
    points = [(0, 0, 0.0), (1, 0, 1.0), (2, 0, 2.0), (3, 1, 10.0), (4, 1, 11.0), (5, 1, 30.0)]
    df = spark.createDataFrame(points, "id long, y int, x double")
    # class 0: the sphere around 0 (radius 10) holds all three; class 1: that around 30 (radius 28) holds all three
    assert subgroups.t1(df, "id", ["x"], "y").first()[0] == pytest.approx(1 / 3, abs=1e-6)
    assert subgroups.t1(df.where("y = 0"), "id", ["x"], "y").first()[0] is None


def test_files(spark, tmp_path):
    assert files.sniffed(["a;b", "1;2", "3;4"]) == (";", True) and files.sniffed(["1\t2", "3\t4"]) == ("\t", False) and files.sniffed(["x|y", "u|v"])[0] == "|"
    (tmp_path / "d.csv").write_text("a|b\n1|x\n2|y\n")
    assert [tuple(r) for r in files.read_csv_sniffed(spark, str(tmp_path / "d.csv")).collect()] == [(1, "x"), (2, "y")]
    (tmp_path / "semi.csv").write_text("a;b;c,d\n1;2;3\n")
    assert tables.read_csv_autosep(spark, str(tmp_path / "semi.csv")).columns == ["a", "b", "c,d"]
    (tmp_path / "site.csv").write_text("1,?\n2,3\n")
    assert [tuple(r) for r in tables.read_csv_headerless(spark, str(tmp_path / "site.csv"), "a int, b int", "s").collect()] == [(1, None, "s"), (2, 3, "s")]
    tagged = tables.tag_provenance(spark.read.csv(str(tmp_path / "d.csv"), sep="|", header=True), "set").first()
    assert (tagged._dataset_source, tagged._dataset_file) == ("set", "d.csv")
    (tmp_path / "cases.csv").write_text("case_id,age\n1,30\n2,40\n")
    (tmp_path / "labels.csv").write_text("case_id,label,more\n2,eczema,z\n")
    assert [tuple(r) for r in files.read_two_files(spark, str(tmp_path / "cases.csv"), str(tmp_path / "labels.csv"), "case_id", ["label"]).collect()] == [(2, 40, "eczema")]
    both, failed = files.load_datasets({"good": lambda: spark.read.csv(str(tmp_path / "cases.csv"), header=True), "bad": lambda: spark.read.csv(str(tmp_path / "none.csv"))})
    assert both.count() == 2 and list(failed) == ["bad"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "p1.csv").write_text("y_true,y_pred\n1,0\n")
    (tmp_path / "m" / "p2.csv").write_text("y_true,y_pred\n1,1\n")
    (tmp_path / "index.json").write_text(json.dumps([{"file": "p1.csv", "model": "lr", "technique": "reweight", "constraint": None}]))
    assert [(r.model, r.technique, r.y_pred) for r in files.read_mitigation_index(spark, str(tmp_path / "index.json"), str(tmp_path / "m")).collect()] == [("lr", "reweight", 0)]
    (tmp_path / "study.json").write_text(json.dumps({"study_id": "s", "runs": [{"sub_key": "k", "mode": "all", "model": "LR", "status": "success"}, {"sub_key": "q", "mode": "all", "model": "LR", "status": "failed"}]}))
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "t.json").write_text("\n".join(json.dumps({"sub_key": k, "dataset": "d", "model": "lr", "f1": 0.5}) for k in "kq"))
    assert [(r.mode, r.model, r.f1) for r in files.read_study_results(spark, str(tmp_path / "study.json"), str(tmp_path / "r")).collect()] == [("all", "lr", 0.5)]
    manifest = files.write_comparison_tables({"a": spark.range(3).toDF("x"), "b": spark.range(2).toDF("x")}, str(tmp_path / "out"), "run")
    assert {(r.table, r.rows) for r in manifest.collect()} == {("a", 3), ("b", 2)} == {(r.table, r.rows) for r in spark.read.json(str(tmp_path / "out" / "manifest")).collect()}
    files.write_splits(spark.createDataFrame([("d", "q", "train", 1), ("d", "q", "test", 2)], "dataset string, binning string, split string, x int"), str(tmp_path / "splits"))
    assert spark.read.parquet(str(tmp_path / "splits")).where("split = 'test'").first().x == 2


def test_models_predict_after_a_query_was_observed(spark, tmp_path):
    files.write_comparison_tables({"a": spark.range(3).toDF("x")}, str(tmp_path / "out"), "run")
    seen = Observation("mine")
    spark.range(4).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 4
    df = spark.createDataFrame([(float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(100)], "a double, b double, y int")
    for fit in (M.train_logistic, M.train_forest, M.train_boosted, M.train_svm):
        assert M.predict(fit(df, ["a", "b"], "y"), df, ["a", "b"]).where("y_pred = y").count() > 90


def test_policies_and_feature_sets(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "i int, t string")
    assert harmonize.missing_policy(df, "keep").count() == 2 and harmonize.missing_policy(df, "drop_rows").count() == 1
    with pytest.raises(ValueError, match="unknown strategy"):
        harmonize.missing_policy(df, "other")
    columns = ["age", "age_group", "sex", "chol"]
    assert harmonize.feature_set(columns, ["age", "sex"], "exclude_sensitive") == ["chol"] and harmonize.feature_set(columns, ["age", "sex"], "include_age_only") == ["age", "age_group", "chol"]
    assert harmonize.feature_set(columns, [], "rfe_top_k", ["chol", "sex", "zz"], 1) == ["chol"]
    model = M.train_logistic(spark.createDataFrame([(0.0, 0), (1.0, 1)] * 5, "x double, y int"), ["x"], "y")
    assert M.feature_importance(model, df, ["x"]).first().importance > 0
