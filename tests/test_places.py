"""Equal rows count as one place with their number, and a view is joined once."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from equilens.operators import density as D
from equilens.operators import models as M
from equilens.operators.places import ROWS, places, silhouette
from equilens.sources.tables import stored, view

DATA = "/root/testdata/sf0.001"


def _rows(spark):
    """60 places, some of them up to seven times, and rows with a null."""
    t = spark.range(60).select(F.col("id").alias("p"), (F.col("id") % 10 / 10 + F.when(F.col("id") < 30, 0).otherwise(5)).alias("x"), (F.col("id") * 7 % 13 / 10).alias("y"))
    t = t.withColumn("c", F.explode(F.sequence(F.lit(0), (F.col("p") % 7).cast("int")))).withColumn("id", F.col("p") * 10 + F.col("c"))
    return t.unionByName(spark.createDataFrame([(99, None, 1.0, 0, 990)], t.schema)).withColumn("label", ((F.col("x") + F.col("c") % 2 * 3) > 4).cast("int"))


def test_silhouette_of_places_is_that_of_all_rows(spark):
    rows = _rows(spark)
    at = places(rows, ["x", "y"])
    assert at.count() == 60 and at.agg(F.sum(ROWS)).first()[0] == rows.count() - 1
    cluster = lambda d: d.withColumn("cluster", F.when(F.col("x") == 0, 2).when(F.col("x") < 5, 0).otherwise(1))
    whole = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(cluster(rows.dropna()))
    assert silhouette(cluster(at), ["x", "y"], "cluster") == pytest.approx(ClusteringEvaluator(predictionCol="cluster").evaluate(whole), abs=1e-9)


def test_a_linear_model_of_places_is_that_of_all_rows(spark):
    rows = _rows(spark).dropna()
    for weight in (None, "c"):
        own = M.train_logistic(rows, ["x", "y"], "label", weight)
        plain = LogisticRegression(regParam=1 / rows.count(), standardization=False, maxIter=100, featuresCol="features", labelCol="label")
        plain = plain.setWeightCol(weight) if weight else plain
        same = plain.fit(VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(rows))
        assert own.coefficients.toArray() == pytest.approx(same.coefficients.toArray(), abs=1e-4)


def test_copies_of_a_row_are_in_its_cluster(spark):
    rows = _rows(spark)
    found = D.dbscan(rows, "id", ["x", "y"], 0.5, 5)
    assert found.count() == rows.count() and found.where("x IS NULL").first()["cluster"] == -1
    per = found.where("x IS NOT NULL").groupBy("p").agg(F.count_distinct("cluster").alias("k"))
    assert per.where("k > 1").isEmpty()


def test_a_stored_view_has_the_rows_of_the_view_and_joins_nothing_again(spark):
    own, plain = stored(spark, DATA, "v_knn"), view(spark, DATA, "v_knn")
    assert own.count() == plain.count() and own.exceptAll(plain).isEmpty()
    assert "Join" not in own._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in view(spark, DATA, "v_knn", "merge")._jdf.queryExecution().executedPlan().toString()
