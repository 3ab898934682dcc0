"""Queries over searches, chained mitigations and measures made of several operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.operators import clustering as K
from equilens.operators import complexity as X
from equilens.operators import density as D
from equilens.operators import models as M
from equilens.operators import neighbours as N
from equilens.operators import search as R
from equilens.operators import subgroups as G
from equilens.operators import thresholds as H
from equilens.sources.tables import stored, view

Query = Callable[[SparkSession, str], DataFrame]
FEATURES = ["f1", "f2"]
CHAINS = [[], ["reweight"], ["undersample"], ["reweight", "thresholds"], ["thresholds", "reweight"]]


def _parts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    z = N.standardized(df.drop("y_pred"), FEATURES)
    return z.where("row_id % 5 <> 0"), z.where("row_id % 5 = 0")


def _combo(df: DataFrame) -> DataFrame:
    train, test = _parts(df)
    return R.gaps(R.mit_combo(train, test, "row_id", FEATURES, "target", "segment", ["reweight", "thresholds"]), "target", "segment")


def _matrix(df: DataFrame) -> DataFrame:
    train, test = _parts(df)
    return R.mit_matrix(train, test, "row_id", FEATURES, "target", ["segment"], CHAINS)


def _sweep(df: DataFrame) -> DataFrame:
    """Two datasets (orders of large and of other customers), two mitigations, split and folds, two models; of folds only logistic models."""
    tables = {(name, "none"): _parts(df.where(rows)) for name, rows in (("debtors", "f2 < 0"), ("others", "f2 >= 0"))}
    choices = {"dataset": ["debtors", "others"], "mitigation": ["baseline", "thresholds"], "method": ["holdout", "cv"], "model": ["logistic", "svm"]}
    done = df.sparkSession.createDataFrame([], "dataset string, mitigation string, model_type string")
    plan = G.sweep_grid(done, choices, [("method", "cv", "model", "svm"), ("model", "svm", "mitigation", "thresholds")])
    return R.sweep(tables, "row_id", FEATURES, "target", "segment", plan, folds=2)


def _models(df: DataFrame) -> DataFrame:
    """Consistency of two models' predictions over the same neighbours of the stated query set, and of both."""
    both = N.consistency_by_cut(df, "row_id", FEATURES, "f1", {"high": 250000, "low": 150000}, F.col("row_id") % 50 == 0, 5, "model")
    return N.consistency_summary(both, ["model"]).select("model", "mean", "n").unionByName(both.agg(F.lit("overall").alias("model"), F.round(F.avg("consistency"), 6).alias("mean"), F.count("*").alias("n")))


def _violations(df: DataFrame) -> DataFrame:
    """Places on two components, up to their sign, and the consistency of the stated query set."""
    z = N.standardized(df, FEATURES)
    near = N.knn_join(z.where("row_id % 50 = 0"), z, "row_id", FEATURES, 5, "y_pred")
    places, _ = M.pca_2d(df, FEATURES, ["row_id"])
    at = places.select("row_id", F.round(F.abs("x"), 2).alias("x"), F.round(F.abs("y"), 2).alias("y"))
    return N.consistency(near, "row_id", 5).join(at, "row_id")


#: The stated query set beside the linear models by group.
ASKED_EVERY = 50


def _asked() -> Column:
    return F.col("row_id") % ASKED_EVERY == 0


def _all_measures(df: DataFrame) -> DataFrame:
    """(metric, value) of all twelve complexity measures and their aliases; all over all rows but T1, which has a sample as its parameter."""
    z = N.standardized(df.drop("y_pred"), FEATURES).withColumn("grp", F.lit("all"))
    found = X.by_group(z, "row_id", "grp", FEATURES, "target", models=True).select("metric", "value")
    return X.with_aliases(found.unionByName(G.t1(z, "row_id", FEATURES, "target").select(F.lit("T1").alias("metric"), F.col("t1").alias("value"))))


def _debtors(df: DataFrame) -> DataFrame:
    """Segments, but customers deep in debt are a (small) group of their own."""
    return N.standardized(df.withColumn("raw", F.col("f2")).drop("y_pred"), FEATURES).withColumn("grp", F.when(F.col("raw") < -980, "DEBT").otherwise(F.col("segment"))).drop("raw")


def _crossed(df: DataFrame) -> DataFrame:
    """Pairs of segment and the sign of the balance."""
    z = N.standardized(df.withColumn("raw", F.col("f2")).drop("y_pred"), FEATURES)
    return X.pairs(z.withColumn("debtor", F.when(F.col("raw") < 0, "yes").otherwise("no")), "segment", "debtor").drop("raw")


def _cluster_run(df: DataFrame) -> DataFrame:
    clustered = K.select(N.standardized(df, FEATURES), FEATURES, "kmeans", (3, 4))
    return G.cluster_list(clustered, FEATURES, "target").join(K.recommend(clustered, "target").select("cluster", "ratio", "priority"), "cluster")


def _gmm(df: DataFrame) -> DataFrame:
    found = K.gmm_candidates(N.standardized(df, FEATURES), FEATURES, (2, 3))
    best = min(found, key=lambda c: c.bic)
    rows = [(c.setting, c.clusters, c.smallest, round(c.silhouette, 4), round(c.bic, 1), c is best) for c in found]
    return df.sparkSession.createDataFrame(rows, "setting string, clusters long, smallest long, silhouette double, bic double, chosen boolean")  # a row for each k


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "v_pred")
    fitted = H.fit_thresholds(df, "grp_b", "y_true", "y_proba", "demographic_parity")
    return H.apply_thresholds(df, fitted, "grp_b", "y_proba", "row_id").select("row_id", "y_pred")


def queries() -> dict[str, Query]:
    def on(op: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: op(stored(spark, sf_dir, "v_knn"))

    return {
        "hpo_search": on(lambda d: R.hpo_search(d, "row_id", FEATURES, "target", {"c": [0.01, 1.0]}, k=2)),
        "mit_grid_search": on(lambda d: R.grid_search(N.standardized(d.drop("y_pred"), FEATURES), FEATURES, "target", "segment")),
        "mit_grid_search_parity": on(lambda d: R.grid_search(N.standardized(d.drop("y_pred"), FEATURES), FEATURES, "target", "segment", constraint="demographic_parity")),
        "mit_combo": on(_combo),
        "mit_matrix": on(_matrix),
        "sweep_run": on(_sweep),
        "similarity_run": on(_models),
        "violation_map": on(_violations),
        "cx_t1": on(partial(G.t1, key="row_id", features=FEATURES, label="target")),
        "complexity_all": on(_all_measures),
        "complexity_by_group": on(lambda d: X.by_group(_debtors(d), "row_id", "grp", FEATURES, "target")),
        "complexity_intersection": on(lambda d: X.by_group(_crossed(d), "row_id", "cell", FEATURES, "target")),
        "complexity_by_group_models": on(lambda d: X.by_group(_debtors(d), "row_id", "grp", FEATURES, "target", _asked(), models=True).where("metric IN ('L1', 'L2', 'L3')")),
        "cluster_run": on(_cluster_run),
        "mit_threshold_apply": _applied,
        "cluster_gmm": on(_gmm),
        "cluster_dbscan": on(lambda d: D.dbscan_grid(N.standardized(d, FEATURES), "row_id", FEATURES, [0.04, 0.2], [5, 10])[0]),
        "cluster_select": on(lambda d: K.choose(N.standardized(d, FEATURES), FEATURES, ks=(3, 4), min_share=0.05)[0]),
    }


_Z = "z AS (SELECT row_id, y_pred, f1 AS raw, round((f1 - avg(f1) OVER ()) / stddev_pop(f1) OVER (), 6) AS f1, round((f2 - avg(f2) OVER ()) / stddev_pop(f2) OVER (), 6) AS f2 FROM v_knn)"
_D = "round(sqrt((q.f1 - r.f1) * (q.f1 - r.f1) + (q.f2 - r.f2) * (q.f2 - r.f2)), 9)"
_NEAR = f"""
{_Z},
near AS (SELECT * FROM (
  SELECT q.row_id, q.raw, r.raw AS other, q.y_pred, r.y_pred AS other_pred, row_number() OVER (PARTITION BY q.row_id ORDER BY {_D}, r.row_id) AS k FROM z q JOIN z r ON q.row_id % 50 = 0 AND q.row_id <> r.row_id) t
  WHERE k <= 5)"""


def _share(salt: str) -> str:
    return f"(CAST('0x' || substr(md5('{salt}:' || CAST(row_id AS VARCHAR)), 1, 7) AS BIGINT) / 268435456.0)"


def _complexity(group: str, name: str) -> str:
    """All measures but those of models, by a group of v_knn."""
    z = "round((f{0} - avg(f{0}) OVER ()) / stddev_pop(f{0}) OVER (), 6) AS f{0}"
    nexts = ", ".join(f"a * f{i} + (1 - a) * coalesce(lead(f{i}) OVER w, first_value(f{i}) OVER w) AS f{i}" for i in (1, 2))
    rank = f"row_number() OVER (PARTITION BY q.row_id ORDER BY {_D}, r.row_id)"
    bounds = ", ".join(f"{a}(f{i}) FILTER (WHERE target = {k}) AS {n}{k}_{i}" for i in (1, 2) for k in (0, 1) for n, a in (("lo", "min"), ("hi", "max")))
    low, high = (lambda i: f"greatest(lo0_{i}, lo1_{i})"), (lambda i: f"least(hi0_{i}, hi1_{i})")
    inside = {i: f"f{i} BETWEEN {low(i)} AND {high(i)}" for i in (1, 2)}
    volume = " * ".join(f"greatest(0, {high(i)} - {low(i)}) / (greatest(hi0_{i}, hi1_{i}) - least(lo0_{i}, lo1_{i}))" for i in (1, 2))
    share = lambda c: f"count(*) FILTER (WHERE {c}) / CAST(count(*) AS DOUBLE)"
    return f"""
WITH a AS (SELECT row_id, target, {group} AS g, {z.format(1)}, {z.format(2)} FROM v_knn), s AS (SELECT g, count(*) AS n, count(*) FILTER (WHERE target = 0) AS n0, count(*) FILTER (WHERE target = 1) AS n1, {bounds} FROM a GROUP BY 1),
z AS (SELECT a.* FROM a JOIN s USING (g) WHERE n >= 50),
o AS (SELECT g, any_value({volume}) AS f2, least({share(inside[1])}, {share(inside[2])}) AS f3, {share(inside[1] + ' AND ' + inside[2])} AS f4 FROM z JOIN s USING (g) GROUP BY 1),
d AS (SELECT q.row_id, q.g, q.target, r.target AS o, {_D} AS dist, {rank} AS k FROM z q JOIN z r ON q.g = r.g AND q.row_id <> r.row_id),
p AS (SELECT row_id, d.g, target, min(dist) FILTER (WHERE target = o) AS same, min(dist) FILTER (WHERE target <> o) AS across, count(*) FILTER (WHERE k = 1 AND target <> o) AS wrong, count(*) FILTER (WHERE k <= 5 AND target <> o) AS others,
  count(*) FILTER (WHERE k <= 5 AND o = 1) AS hits, coalesce(min(k) FILTER (WHERE o = 0 AND k <= least(100, n - 1) - 1) - 2, least(100, any_value(n) - 1)) AS far, any_value(n0 / CAST(n1 AS DOUBLE)) AS ratio FROM d JOIN s USING (g) GROUP BY ALL),
b AS (SELECT *, m / CAST(size AS DOUBLE) AS own, (size - m) / CAST(size AS DOUBLE) AS oth FROM (SELECT *, CASE WHEN hits = 5 THEN far ELSE hits END AS m, CASE WHEN hits = 5 THEN far + 1 ELSE 5 END AS size FROM p) q),
c AS (SELECT g, target, sum(same) / (sum(across) + 1e-12) AS r, avg(wrong) AS wrong, count(*) AS n, count(*) FILTER (WHERE others > 2) AS hit, avg(ratio * oth / (ratio * oth + own + 1e-12) - oth / (oth + own + 1e-12)) FILTER (WHERE target = 1) AS gap FROM b GROUP BY ALL),
e AS (SELECT g, CASE WHEN count(*) = 2 THEN avg(r / (1 + r)) END AS n2, CASE WHEN count(*) = 2 THEN avg(wrong) END AS n3, max(gap) AS bayes, coalesce(max(n) FILTER (WHERE target = 0), 0) / CAST(greatest(coalesce(max(n) FILTER (WHERE target = 1), 0), 1) AS DOUBLE) AS ir, coalesce(max(hit) FILTER (WHERE target = 0), 0) AS h0, coalesce(max(hit) FILTER (WHERE target = 1), 0) AS h1 FROM c GROUP BY 1),
u AS (SELECT *, floor({_share('bucket')} * ceil((SELECT count(*) FROM z) / 10000.0)) AS bucket, {_share('pair')} AS u, {_share('mix')} AS a FROM z), m AS (SELECT row_id, g, target, {nexts} FROM u WINDOW w AS (PARTITION BY target, g, bucket ORDER BY u, row_id)),
n4 AS (SELECT g, CASE WHEN count(*) = 2 THEN avg(e) END AS n4 FROM (SELECT g, target, avg(CASE WHEN target <> o THEN 1.0 ELSE 0.0 END) AS e FROM (SELECT q.g, q.target, r.target AS o, {rank} AS k FROM m q JOIN z r ON q.g = r.g) x WHERE k = 1 GROUP BY ALL) y GROUP BY 1),
l AS (SELECT g, 'F2' AS metric, f2 AS value FROM o UNION ALL SELECT g, 'F3', f3 FROM o UNION ALL SELECT g, 'F4', f4 FROM o UNION ALL SELECT g, 'N2', n2 FROM e UNION ALL SELECT g, 'N3', n3 FROM e UNION ALL SELECT g, 'N4', n4 FROM n4 UNION ALL SELECT g, 'Raug', (h0 + ir * h1) / (ir + 1) FROM e UNION ALL SELECT g, 'BayesImbalance', bayes FROM e)
SELECT s.g AS {name}, n, CASE WHEN n >= 50 THEN 'ok' ELSE 'skipped' END AS status, metric, round(value, 6) AS value FROM s LEFT JOIN l USING (g)"""


def oracle_sql() -> dict[str, str]:
    per = " UNION ALL ".join(f"SELECT '{n}' AS model, row_id, count(*) FILTER (WHERE (raw >= {x}) = (other >= {x})) / 5.0 AS c FROM near GROUP BY 2" for n, x in (("high", 250000), ("low", 150000)))
    return {
        "complexity_by_group": _complexity("CASE WHEN f2 < -980 THEN 'DEBT' ELSE segment END", "grp"),
        "complexity_intersection": _complexity("'segment=' || segment || '|debtor=' || CASE WHEN f2 < 0 THEN 'yes' ELSE 'no' END", "cell"),
        "similarity_run": f"""
WITH {_NEAR}, p AS ({per})
SELECT model, round(avg(c), 6) AS mean, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT 'overall', round(avg(c), 6), count(*) FROM p""",
        "violation_map": f"""
WITH {_NEAR}, s AS (SELECT sign(corr(f1, f2)) AS s FROM z), c AS (SELECT row_id, count(*) FILTER (WHERE y_pred = other_pred) / 5.0 AS consistency FROM near GROUP BY 1)
SELECT row_id, consistency, round(abs(f1 + s * f2) / sqrt(2), 2) AS x, round(abs(f1 - s * f2) / sqrt(2), 2) AS y FROM c JOIN z USING (row_id), s""",
    }
