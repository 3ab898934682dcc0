"""Constrained training, synthetic rows and JSON sources on small tables with a known answer."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from equilens.operators import complexity as X
from equilens.operators import models as M
from equilens.operators import neighbours as N
from equilens.operators import synthesis as Y
from equilens.operators import thresholds as H
from equilens.plans import discovery, modelling
from equilens.sources import results as R


@pytest.fixture(scope="module")
def biased(spark):
    r = np.random.default_rng(0)
    rows = []
    for i in range(600):
        g = i % 2
        x = float(r.normal(1.5 * g, 1))
        rows.append((i, x, float(r.normal()), "ab"[g], int(x + r.normal(0, 0.5) > 0.75)))
    return spark.createDataFrame(rows, "id long, x double, u double, g string, y int").cache()


def gap(df):
    rates = [r.p for r in df.groupBy("g").agg(F.avg("y_pred").alias("p")).collect()]
    return max(rates) - min(rates)


def test_exponentiated_gradient_shrinks_the_gap(biased):
    f = ["x", "u"]
    plain = gap(M.predict(M.train_logistic(biased, f, "y"), biased, f))
    rows = biased.withColumn("gx", (F.col("g") == "b").cast("double"))
    mixture = M.exponentiated_gradient(rows, [*f, "gx"], "y", "g", steps=20)
    assert len(mixture.gaps) < 20 and mixture.gap <= 0.01 and sum(mixture.weights) == pytest.approx(1)  # an equilibrium
    assert mixture.gaps == sorted(mixture.gaps, reverse=True)
    fair = M.predict_mixture(mixture, rows, [*f, "gx"])
    assert plain > 0.4 and gap(fair) < plain / 2
    assert fair.where((F.col("y_pred") == F.col("y"))).count() > 0.6 * 600


def test_equilibrium_by_brute_force():
    # each of the first models is off by 0.2; half and half is fair
    w, push, value = M.equilibrium(np.array([0.1, 0.1, 0.4]), np.array([[0.2, -0.2], [-0.2, 0.2], [0.0, 0.0]]), 0.01, 100.0)
    assert w[2] == pytest.approx(0) and w[0] == pytest.approx(0.5, abs=0.026) and value == pytest.approx(0.1)
    r = np.random.default_rng(3)
    for _ in range(20):
        e, o = r.random(3), r.normal(0, 0.3, (3, 2))
        w, push, value = M.equilibrium(e, o, 0.05, 20.0)
        cost = lambda x: e @ x + 20 * max(0, np.abs(o.T @ x).max() - 0.05)  # noqa: B023, E731
        grid = [np.array([a, b, 1 - a - b]) for a in np.linspace(0, 1, 101) for b in np.linspace(0, 1 - a, 101)]
        assert cost(w) == pytest.approx(value) and value <= min(map(cost, grid)) + 1e-9
        # and no mixture beats the multipliers: the value is what they guarantee
        assert value == pytest.approx((e + o @ push).min() - 0.05 * np.abs(push).sum(), abs=1e-9)


@pytest.mark.parametrize("constraint", ["demographic_parity", "equalized_odds"])
def test_effects_by_brute_force(biased, constraint):
    rows = biased.withColumn("gx", (F.col("g") == "b").cast("double"))
    game = M.Reduction(rows, ["x", "gx"], "y", "g", constraint)
    push = {c: 0.3 * (-1) ** i for i, c in enumerate(game.cells)}
    model = game.respond(push)
    error, off = game.effect(model)
    made = M.predict(model, rows, ["x", "gx"]).toPandas()
    assert error == pytest.approx((made.y != made.y_pred).mean())
    for c in game.cells:
        event = made[made.y == c[1]] if len(c) > 1 else made
        assert off[c] == pytest.approx(event[event.g == c[0]].y_pred.mean() - event.y_pred.mean())


def test_out_of_fold_covers_each_row_once(biased):
    out = M.cv_out_of_fold(biased.withColumn("fold", (F.col("id") % 3).cast("int")), ["x", "u"], "y", "fold", 3)
    assert out.select("id").distinct().count() == out.count() == 600
    assert out.where(F.col("y_pred") == F.col("y")).count() > 0.75 * 600


@pytest.mark.parametrize("op", [Y.smote, Y.adasyn])
def test_new_rows_lie_within_the_smaller_class(biased, op):
    few = biased.where((F.col("y") == 0) | (F.col("id") % 4 == 0))
    n = {r.y: r["count"] for r in few.groupBy("y").count().collect()}
    made = op(few, few, "id", ["x", "u"], "y").collect()
    own = few.where("y = 1").agg(F.min("x"), F.max("x"), F.min("u"), F.max("u")).first()
    assert 0.7 * (n[0] - n[1]) < len(made) < 1.3 * (n[0] - n[1])
    assert all(own[0] - 1e-9 <= r.x <= own[1] + 1e-9 and own[2] - 1e-9 <= r.u <= own[3] + 1e-9 and r.y == 1 for r in made)


@pytest.mark.parametrize("name", ["mit_smote", "mit_adasyn"])
def test_every_row_of_the_smaller_class_is_a_base(spark, tmp_path, name):
    # odd ids only: none is divisible by 50
    rows = [(2 * i + 1, i % 7, "F" if i % 4 == 0 else "O", float(i * 37 % 1000)) for i in range(400)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(i, i * 100.0, "s") for i in range(7)], "c_custkey long, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    made = modelling.queries()[name](spark, str(tmp_path)).collect()
    assert 160 <= len(made) <= 240 and len({r.base for r in made}) > (95 if name == "mit_smote" else 60)
    assert {r.base for r in made} <= {2 * i + 1 for i in range(0, 400, 4)}


def test_adasyn_searches_once_for_each_step(spark, biased, monkeypatch):
    runs, asked, search = [], [], Y.knn_partitions

    def counted(queries, *args):
        n = spark.sparkContext.accumulator(0)

        def run(batches):
            for b in batches:
                n.add(b.num_rows)
                yield b

        found = search(queries, *args)
        runs.append(n), asked.append(queries.count())
        return found.mapInArrow(run, found.schema)

    monkeypatch.setattr(Y, "knn_partitions", counted)
    few = biased.where((F.col("y") == 0) | (F.col("id") % 3 > 0))
    made = Y.adasyn(few, few, "id", ["x", "u"], "y").collect()
    bases = {r.base for r in made}
    assert [n.value for n in runs] == [5 * n for n in asked]  # each search ran once
    assert asked == [few.where("y = 1").count(), len(bases)] and asked[1] < asked[0]  # the second only for bases with a copy


@pytest.mark.parametrize("scan", [True, False])
def test_interpolations_are_made_once(spark, biased, monkeypatch, scan):
    n, make = spark.sparkContext.accumulator(0), M.interpolations

    def run(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    def counted(*args, **more):
        made = make(*args, **more)
        return made.mapInArrow(run, made.schema)

    for module in (M, Y):
        monkeypatch.setattr(module, "interpolations", counted)
    if not scan:
        monkeypatch.setattr(N, "SCAN_QUERIES", 0)
    assert Y.n4(biased, "id", ["x", "u"], "y", 2).collect()[0].n4 is not None and n.value == 600
    X.neighbourhood(biased, "id", "g", ["x", "u"], "y", F.col("id") % 2 == 0).collect()
    assert n.value == 2 * 600


def test_partitions_agree_with_the_join(spark, biased):
    for k, size in ((5, 60), (1, 10**6)):
        a, b = (sorted(map(tuple, d.collect())) for d in (N.knn_partitions(biased, biased, "id", ["x", "u"], k, "y", size), N.knn_join(biased, biased, "id", ["x", "u"], k, "y")))
        assert a == b and len(a) == 600 * k
    # ten features, the first of three values; one place holds a third of all rows
    r = np.random.default_rng(9)
    f = [f"f{i}" for i in range(10)]
    rows = [(i, i % 2, float(i % 3), *(([0.0] * 9) if i % 3 == 0 else map(float, np.round(r.normal(0, [3, 3, 3, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1]), 2)))) for i in range(450)]
    df = spark.createDataFrame(rows, "id long, y int, " + ", ".join(f"{c} double" for c in f))
    report = {}
    a, b = (sorted(map(tuple, d.collect())) for d in (N.knn_partitions(df, df, "id", f, 4, "y", 50, report), N.knn_join(df, df, "id", f, 4, "y")))
    assert a == b and len(a) == 450 * 4 and report["leaves"] > 3 and report["visits"] < report["leaves"]
    assert N.knn_partitions(df.limit(0), df, "id", f, 4, "y").count() == 0 and N.knn_partitions(df, df.limit(0), "id", f, 4, "y").count() == 0


@pytest.mark.parametrize("by,per_label", [(None, False), ("g", False), (None, True), ("g", True)])
def test_large_query_sets_are_searched_by_partitions(spark, monkeypatch, by, per_label):
    # places are repeated, one of them 500 times; a small group, and labels that lie apart
    r = np.random.default_rng(3)
    x, u = np.round(r.normal(size=1500) * 4, 1), np.round(r.normal(size=1500), 1)
    x[::3], u[::3] = 0.5, 0.5
    rows = [(i, int(x[i] > 2), "small" if i % 100 == 1 else "ab"[i % 2], float(x[i]), float(u[i])) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, y int, g string, x double, u double")
    asked = df.where("id % 3 < 2")
    want = N.knn_join(asked, df, "id", ["x", "u"], 7, "y", by=by, per_label=per_label)
    report = {}
    got = N.knn_partitions(asked, df, "id", ["x", "u"], 7, "y", 60, report, by=by, per_label=per_label)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns
    assert report["leaves"] > 8 and report["visits"] < report["leaves"] / 2
    monkeypatch.setattr(N, "SCAN_PAIRS", 1000)
    monkeypatch.setattr(N, "_scan", lambda *a: pytest.fail("queries times rows"))
    again = N.knn_join(asked, df, "id", ["x", "u"], 7, "y", by=by, per_label=per_label)
    assert again.count() == want.count()


def test_leaves_meet_in_few_calls_and_other_leaves_at_their_edges(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(i, i % 2, *map(float, r.uniform(size=2))) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, y int, x double, u double")
    asked = df.where("id % 50 = 0")
    want = sorted(map(tuple, N.knn_join(asked, df, "id", ["x", "u"], 3, "y").collect()))
    calls, edge, run = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), N._found

    def counted(q, r, *more):
        calls.add(1)
        edge.add(len(r) if "_r" in q.column_names else 0)
        return run(q, r, *more)

    monkeypatch.setattr(N, "_found", counted)
    report = {}
    assert sorted(map(tuple, N.knn_partitions(asked, df, "id", ["x", "u"], 3, "y", 400, report).collect())) == want
    assert report["leaves"] >= 50 and 0 < calls.value < report["leaves"] and 0 < edge.value < 20_000 / 2


def test_segments_are_joined_for_the_queries_only(spark):
    t = discovery.queries()["knn_consistency_by_group"](spark, "/root/testdata/sf0.001")
    assert "% 50" in t._jdf.queryExecution().optimizedPlan().toString() and t.count() == 5


def test_results_and_pairs(spark, tmp_path):
    (tmp_path / "r").mkdir()
    base = {"dataset": "d", "status": "ok", "fairness_metrics": {"sex": {"dp": 0.2}}}
    (tmp_path / "r" / "1.json").write_text(json.dumps(base | {"experiment_id": "a", "test_metrics": {"f1": 0.5, "auc": 0.7}, "cv_results": {"f1": {"mean": 0.6, "std": 0.1}}}, indent=1))
    (tmp_path / "r" / "2.json").write_text(json.dumps(base | {"experiment_id": "b", "test_metrics": {"f1": 0.4}}))
    (tmp_path / "r" / "3.json").write_text("no json")
    got = R.read_experiment_results(spark, str(tmp_path / "r"), ["f1", "auc"])
    assert sorted((r.experiment_id, r.f1_value, r.auc_value) for r in got.collect()) == [("a", 0.6, 0.7), ("b", 0.4, None)]
    assert sorted(tuple(r) for r in R.fairness_gaps(got).collect()) == [("a", "d", "sex", "dp", 0.2), ("b", "d", "sex", "dp", 0.2)]
    (tmp_path / "p").mkdir()
    for n in ("d_lr_train", "d_lr_test", "d_rf_train"):
        (tmp_path / "p" / f"{n}.csv").write_text("y_true,y_pred\n1,0\n")
    assert {(r.run, r.part) for r in R.prediction_pairs(spark, str(tmp_path / "p")).collect()} == {("d_lr", "train"), ("d_lr", "test")}


def test_sinks_and_listing(spark, biased, tmp_path):
    R.write_partitioned(biased, str(tmp_path / "w"), ["g"])
    assert spark.read.parquet(str(tmp_path / "w")).where("g = 'a'").count() == 300
    for _ in range(2):
        R.append_run_history(biased.limit(1).select("id"), str(tmp_path / "h"))
    assert R.scan_history(spark, str(tmp_path / "h"), "id long").count() == 2
    assert json.loads(R.profile_json(biased.limit(1), "rows").first()["json"]).keys() == {"id", "x", "u", "g", "y"}
    for d in ("a", "b"):
        (tmp_path / "i" / d).mkdir(parents=True)
        (tmp_path / "i" / d / "p.png").write_bytes(b"x")
    (tmp_path / "i" / "a" / "q.jpg").write_bytes(b"x")
    listed, twice = R.image_listing(spark, str(tmp_path / "i"))
    assert {r["name"]: r.path.split("/")[-2] for r in listed.collect()} == {"p.png": "b", "q.jpg": "a"}
    assert [tuple(r) for r in twice.collect()] == [("p.png", 2)]


def test_thresholds_level_the_groups(biased):
    f = ["x", "u"]
    scored = M.predict(M.train_forest(biased, f, "y"), biased, f)
    assert scored.where(F.col("y_pred") == F.col("y")).count() > 0.75 * 600
    fitted = H.fit_thresholds(scored, "g", "y", "y_proba")
    assert gap(H.apply_thresholds(scored, fitted, "g", "y_proba", "id")) < 0.05 < gap(scored)
    one = scored.where("g = 'a' OR y = 1")
    assert [r.g for r in H.fit_thresholds(one, "g", "y", "y_proba").collect()] == ["a"]
    assert H.apply_thresholds(one, H.fit_thresholds(one, "g", "y", "y_proba"), "g", "y_proba", "id").where("g = 'b'").exceptAll(one.where("g = 'b'")).count() == 0


def test_hull_in_pieces(spark):
    r = np.random.default_rng(4)
    rows = [(int(g), float(s), int(r.random() < s ** (g + 1))) for g in range(3) for s in np.round(r.random(300), 2)]
    df = spark.createDataFrame(rows, "g int, s double, y int")
    want = {}
    for g in range(3):
        own = [(s, y) for k, s, y in rows if k == g]
        pts = {(0, 0)} | {(sum(1 - y for s, y in own if s >= t), sum(y for s, y in own if s >= t)) for t in {s for s, _ in own}}
        on = lambda p: not any(a[0] < p[0] < c[0] and (p[0] - a[0]) * (c[1] - a[1]) >= (p[1] - a[1]) * (c[0] - a[0]) for a in pts for c in pts)  # noqa: B023, E731
        want[g] = sorted(p for p in pts if on(p) and p[1] == max(q[1] for q in pts if q[0] == p[0]))
    for size in (7, 60, 10**6):  # in many pieces, in rounds, and at once
        hull = H.roc_hull(df, "g", "y", "s", size).collect()
        assert {g: sorted((v.x, v.y) for v in hull if v.grp == g) for g in range(3)} == want
        same = sorted(map(tuple, H.curve(df, "g", "y", "s", size).collect()), key=str)
        assert same == sorted(map(tuple, H.curve(df, "g", "y", "s").collect()), key=str)
    # by brute force: the best rate of the grid at which all hulls reach as high
    reach = lambda g, x: max(a[1] + (c[1] - a[1]) * (x - a[0]) / max(c[0] - a[0], 1e-12) if a[0] < x else a[1] for a in want[g] for c in want[g] if a[0] <= x <= c[0] and (a != c or a[0] == x))
    ends = {g: want[g][-1] for g in range(3)}
    best = max(range(101), key=lambda k: (round(min(reach(g, k * ends[g][0] / 100) / ends[g][1] for g in range(3)) - k / 100, 9), -k))
    fitted = H.fit_thresholds(df, "g", "y", "s", "equalized_odds").collect()
    assert {r.rate for r in fitted} == {best / 100} and len(fitted) == 3
    assert {r.tpr for r in fitted} == {round(min(reach(g, best * ends[g][0] / 100) / ends[g][1] for g in range(3)), 6)}


def test_equalized_odds_levels_both_rates(spark):
    r = np.random.default_rng(5)
    rows = [(i, "abc"[i % 3], float(np.clip(0.5 + (y - 0.5) * (0.2 + 0.15 * (i % 3)) + r.normal(0, 0.2) + 0.05 * (i % 3), 0, 1)), y) for i in range(9000) for y in [int(r.random() < 0.4)]]
    df = spark.createDataFrame(rows, "id long, g string, s double, y int").cache()
    made = H.apply_thresholds(df, H.fit_thresholds(df, "g", "y", "s", "equalized_odds"), "g", "s", "id")
    spread = lambda d, y: np.ptp([v.p for v in d.where(f"y = {y}").groupBy("g").agg(F.avg("y_pred").alias("p")).collect()])
    plain = df.withColumn("y_pred", (F.col("s") >= 0.5).cast("int"))
    assert spread(plain, 1) > 0.15 and spread(made, 1) < 0.05 and spread(made, 0) < 0.05
    one = df.where("g = 'a' OR y = 1")  # a group with one class keeps its predictions
    fitted = H.fit_thresholds(one, "g", "y", "s", "equalized_odds")
    assert [v.g for v in fitted.collect()] == ["a"]
    assert H.fit_thresholds(df.limit(0), "g", "y", "s", "equalized_odds").count() == 0
