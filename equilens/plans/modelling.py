"""Queries over models, constrained training, synthetic rows and the complexity measures that need them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.operators import models as M
from equilens.operators import neighbours as N
from equilens.operators import preparation as P
from equilens.operators import synthesis as Y
from equilens.operators import thresholds as H
from equilens.sources.tables import stored, view

Query = Callable[[SparkSession, str], DataFrame]
FEATURES = ["f1", "f2"]
#: Every row whose id is divisible by this is a query of the neighbour joins; by TEST, a test row.
ASKED, TEST, FOLDS = 50, 5, 3


def _z(df: DataFrame) -> DataFrame:
    return N.standardized(df.drop("y_pred"), FEATURES)


def _parts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    z = _z(df)
    return z.where(F.col("row_id") % TEST != 0), z.where(F.col("row_id") % TEST == 0)


def _trained(fit: M.Fit) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        train, test = _parts(df)
        return M.performance(M.predict(fit(train, FEATURES, "target"), test, FEATURES), "target")

    return run


def _importance(df: DataFrame) -> DataFrame:
    train, _ = _parts(df)
    return M.feature_importance(M.train_forest(train, FEATURES, "target"), df, FEATURES)


def _out_of_fold(df: DataFrame) -> DataFrame:
    folded = P.folds_stratified(_z(df), "row_id", ["target"], FOLDS)
    return M.performance(M.cv_out_of_fold(folded, FEATURES, "target", "fold", FOLDS), "target", ["fold"])


def _by_segment(df: DataFrame) -> DataFrame:
    return M.performance(df, "target", ["segment"])


def _reweighted(df: DataFrame) -> DataFrame:
    train, test = _parts(df)
    plain = M.train_logistic(train, FEATURES, "target")
    weighted = M.train_logistic(P.reweight(train, "target", "segment"), FEATURES, "target", "weight")
    return M.before_after(_by_segment(M.predict(plain, test, FEATURES)), _by_segment(M.predict(weighted, test, FEATURES)), ["segment"], ["accuracy", "recall", "selection_rate"])


def _constrained(df: DataFrame) -> DataFrame:
    train, test = _parts(df)
    return _by_segment(M.predict_mixture(M.exponentiated_gradient(train, FEATURES, "target", "segment"), test, FEATURES))


def _asked(df: DataFrame) -> DataFrame:
    return df.where(F.col("row_id") % ASKED == 0)


def _grown(op: Callable[..., DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        z = _z(df)
        return op(z, _asked(z), "row_id", FEATURES, "target")

    return run


def _made(op: Callable[..., DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        z = _z(df)
        return op(z, z, "row_id", FEATURES, "target")

    return run


def queries() -> dict[str, Query]:
    def on(op: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: op(stored(spark, sf_dir, "v_knn"))

    return {
        "train_logistic": on(_trained(M.train_logistic)),
        "train_forest": on(_trained(M.train_forest)),
        "train_boosted": on(_trained(M.train_boosted)),
        "train_svm": on(_trained(M.train_svm)),
        "feature_importance": on(_importance),
        "cv_out_of_fold": on(_out_of_fold),
        "mit_before_after": on(_reweighted),
        "mit_exp_gradient": on(_constrained),
        "mit_smote": on(_made(Y.smote)),
        "mit_adasyn": on(_made(Y.adasyn)),
        **{f"mit_threshold_{c}": (lambda spark, sf_dir, c=c: H.fit_thresholds(view(spark, sf_dir, "v_pred"), "grp_b", "y_true", "y_proba", c)) for c in (*H.CONSTRAINTS, H.BOTH_RATES)},
        "roc_hull": lambda spark, sf_dir: H.roc_hull(view(spark, sf_dir, "v_pred"), "grp_b", "y_true", "y_proba").withColumnRenamed("grp", "grp_b"),
        "pca_2d": on(lambda d: M.pca_2d(d, FEATURES)[1].withColumn("explained", F.round("explained", 4))),
        "cx_l1_l2_l3": on(lambda d: M.complexity_l(_z(d), "row_id", FEATURES, "target")),
        "cx_n4": on(lambda d: Y.n4(_z(d), "row_id", FEATURES, "target", ASKED)),
        "cx_bayes": on(_grown(Y.bayes_imbalance)),
    }


_Z = "z AS (SELECT row_id, target, round((f1 - avg(f1) OVER ()) / stddev_pop(f1) OVER (), 6) AS f1, round((f2 - avg(f2) OVER ()) / stddev_pop(f2) OVER (), 6) AS f2 FROM v_knn)"
_D = "round(sqrt((q.f1 - r.f1) * (q.f1 - r.f1) + (q.f2 - r.f2) * (q.f2 - r.f2)), 9)"


def _share(salt: str) -> str:
    return f"(CAST('0x' || substr(md5('{salt}:' || CAST(row_id AS VARCHAR)), 1, 7) AS BIGINT) / 268435456.0)"


def _thresholds(tp: str, n: str) -> str:
    x = {k: f"CAST({tp.format(k)} AS DOUBLE) / ({n}) * 100" for k in (0, 1)}
    return (
        "WITH c AS (SELECT grp_b, y_proba AS s, sum(y_true) AS p, sum(1 - y_true) AS q FROM v_pred GROUP BY 1, 2),"
        " w AS (SELECT *, sum(p) OVER (PARTITION BY grp_b) AS pn, sum(q) OVER (PARTITION BY grp_b) AS qn, sum(p) OVER d AS tp1, sum(q) OVER d AS fp1, lag(s) OVER d AS upper_s FROM c WINDOW d AS (PARTITION BY grp_b ORDER BY s DESC)),"
        f" x AS (SELECT *, {x[0]} AS x0, {x[1]} AS x1 FROM (SELECT *, tp1 - p AS tp0, fp1 - q AS fp0 FROM w WHERE pn > 0 AND qn > 0) w0),"
        " m AS (SELECT x.*, g, (g - x0) / (x1 - x0) AS mix FROM x JOIN range(101) r(g) ON g >= x0 AND (g < x1 OR g = 100 AND x1 = 100) WHERE x1 > x0),"
        " o AS (SELECT g, round(sum(tp0 + mix * p) / sum(pn) - sum(fp0 + mix * q) / sum(qn), 9) AS gain FROM m GROUP BY 1)"
        " SELECT grp_b, g / 100.0 AS rate, upper_s AS \"upper\", s AS \"lower\", round(mix, 6) AS mix FROM m WHERE g = (SELECT g FROM o ORDER BY gain DESC, g LIMIT 1)"
    )


#: A point of a curve is a vertex of its upper hull if no pair of points to both sides of it reaches as high; the hull starts with the highest point of the least x.
_HULL = (
    "c AS (SELECT grp_b, y_proba AS s, sum(y_true) AS p, sum(1 - y_true) AS q FROM v_pred GROUP BY 1, 2),"
    " u AS (SELECT grp_b, CAST(sum(q) OVER d AS BIGINT) AS x, CAST(sum(p) OVER d AS BIGINT) AS y, s, CAST(sum(p) OVER w AS BIGINT) AS pn, CAST(sum(q) OVER w AS BIGINT) AS qn FROM c WINDOW d AS (PARTITION BY grp_b ORDER BY s DESC), w AS (PARTITION BY grp_b)),"
    " pts AS (SELECT * FROM (SELECT * FROM u UNION ALL SELECT DISTINCT grp_b, 0, 0, NULL, pn, qn FROM u) z WHERE pn > 0 AND qn > 0 QUALIFY row_number() OVER (PARTITION BY grp_b, x ORDER BY y DESC) = 1),"
    " hull AS (SELECT * FROM pts b WHERE NOT EXISTS (SELECT 1 FROM pts a JOIN pts c ON a.grp_b = c.grp_b WHERE a.grp_b = b.grp_b AND a.x < b.x AND c.x > b.x AND (b.x - a.x) * (c.y - a.y) >= (b.y - a.y) * (c.x - a.x)))"
)


def _equalized_odds() -> str:
    return (
        f"WITH {_HULL}, e AS (SELECT *, lead(x) OVER w AS xn, lead(y) OVER w AS yn, lead(s) OVER w AS lower_s FROM hull WINDOW w AS (PARTITION BY grp_b ORDER BY x)),"
        " f AS (SELECT *, CAST(x AS DOUBLE) / qn * 100 AS x0, CAST(xn AS DOUBLE) / qn * 100 AS x1 FROM e WHERE xn IS NOT NULL),"
        " m AS (SELECT *, (y + mix * (yn - y)) / pn AS own FROM (SELECT f.*, g, (g - x0) / (x1 - x0) AS mix FROM f JOIN range(101) r(g) ON g >= x0 AND (g < x1 OR g = x1 AND xn = qn)) z),"
        " b AS (SELECT g, min(own) AS tpr FROM m GROUP BY 1 ORDER BY round(min(own) - g / 100.0, 9) DESC, g LIMIT 1)"
        ' SELECT grp_b, g / 100.0 AS rate, round(tpr, 6) AS tpr, s AS "upper", lower_s AS "lower", round(mix, 6) AS mix, CASE WHEN own > g / 100.0 THEN round((own - tpr) / (own - g / 100.0), 6) ELSE 0 END AS "ignore" FROM m JOIN b USING (g)'
    )


def oracle_sql() -> dict[str, str]:
    nexts = ", ".join(f"a * f{i} + (1 - a) * coalesce(lead(f{i}) OVER w, first_value(f{i}) OVER w) AS f{i}" for i in (1, 2))
    pairs = f"b AS (SELECT *, floor({_share('bucket')} * ceil((SELECT count(*) FROM z) / 10000.0)) AS bucket, {_share('pair')} AS u, {_share('mix')} AS a FROM z), mixed AS (SELECT row_id, target, {nexts} FROM b WINDOW w AS (PARTITION BY target, bucket ORDER BY u, row_id))"
    near = f"near AS (SELECT q.row_id, r.target, row_number() OVER (PARTITION BY q.row_id ORDER BY {_D}, r.row_id) AS k FROM z q JOIN z r ON q.row_id % {ASKED} = 0 AND q.target = 1 AND q.row_id <> r.row_id)"
    wide = "count(*) FILTER (WHERE k <= 5 AND target = 1)"
    return {
        "mit_threshold_demographic_parity": _thresholds("(tp{0} + fp{0})", "pn + qn"),
        "mit_threshold_true_positive_rate": _thresholds("tp{0}", "pn"),
        "mit_threshold_false_positive_rate": _thresholds("fp{0}", "qn"),
        "mit_threshold_equalized_odds": _equalized_odds(),
        "roc_hull": f"WITH {_HULL} SELECT grp_b, x, y, s, pn, qn FROM hull",
        "pca_2d": "SELECT component, round((1 + side * r) / 2, 4) AS explained FROM (SELECT abs(corr(f1, f2)) AS r FROM v_knn) c, (VALUES (1, 1), (2, -1)) v(component, side)",
        "cx_n4": f"WITH {_Z}, {pairs}, n AS (SELECT q.row_id, q.target, r.target AS o, row_number() OVER (PARTITION BY q.row_id ORDER BY {_D}, r.row_id) AS k FROM mixed q JOIN z r ON q.row_id % {ASKED} = 0) SELECT round(CASE WHEN count(*) = 2 THEN avg(e) END, 6) AS n4 FROM (SELECT target, avg(CASE WHEN target <> o THEN 1.0 ELSE 0.0 END) AS e FROM n WHERE k = 1 GROUP BY 1) t",
        "cx_bayes": f"WITH {_Z}, {near}, p AS (SELECT row_id, {wide} AS hits, coalesce(min(k) FILTER (WHERE target = 0) - 2, 100) AS far FROM near WHERE k <= 99 GROUP BY 1), s AS (SELECT CASE WHEN hits = 5 THEN far ELSE hits END AS m, CASE WHEN hits = 5 THEN far + 1 ELSE 5 END AS size FROM p),"
        " f AS (SELECT m / CAST(size AS DOUBLE) AS own, (size - m) / CAST(size AS DOUBLE) AS oth, (SELECT count(*) FILTER (WHERE target = 0) / CAST(count(*) FILTER (WHERE target = 1) AS DOUBLE) FROM z) AS ratio FROM s) SELECT round(avg(ratio * oth / (ratio * oth + own + 1e-12) - oth / (oth + own + 1e-12)), 6) AS bayes FROM f",
    }
