"""Joins with hot keys, and connected components of large graphs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it has more than one row in so many; there are fewer such keys than this.
HOT = 1000


def hot_join(many: DataFrame, one: DataFrame, on: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """`many` joined to `one`, which has a row for each key and the key's number of rows in `many` (`size`).

    Keys with more than a thousandth of all `total` rows meet their partner by
    broadcast (at most a thousand rows of `one`), so that none of them is
    gathered in a task; all other keys are shuffled. `how` is inner or left;
    rows with a null key find no partner and aren't shuffled at all.
    """
    if how == "left":
        none = {f.name: F.lit(None).cast(f.dataType) for f in one.schema.fields if f.name != on}
        lone = many.where(F.col(on).isNull()).withColumns(none)
        return lone.unionByName(_hot_join(many.where(F.col(on).isNotNull()), one, on, size, total, how))
    return _hot_join(many, one, on, size, total, how)


def _hot_join(many: DataFrame, one: DataFrame, on: str, size: str, total: int, how: str) -> DataFrame:
    is_hot = F.col(size) * HOT > total
    hot = F.broadcast(one.where(is_hot).withColumn("_hot", F.lit(True)))
    met = many.join(hot, on, "left")
    rest = many.join(F.broadcast(one.where(is_hot).select(on)), on, "left_anti").join(one.where(~is_hot), on, how)
    return met.where("_hot").drop("_hot").unionByName(rest)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see.

    Where the setting is missing a local session (as in tests) gets a temporary
    folder; a cluster without the setting is an error.
    """
    context = spark.sparkContext
    top, known = spark.conf.get("spark.checkpoint.dir", None), context._jsc.sc().getCheckpointDir()
    if not top and known.isDefined():
        top = known.get()
    elif not top:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="equilens-")
    if not known.isDefined():
        context.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def deleted(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` in the folder that all executors share: cuts the lineage and survives lost executors."""
    shared_folder(df.sparkSession, "")
    return df.checkpoint()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component) of all `nodes`: the least id that edges (a, b) lead to.

    Large-star steps link a node's larger neighbours to its least neighbour,
    small-star steps its smaller ones and itself. The number of edges never
    grows, and that of rounds is logarithmic in the longest chain. Each round is
    checkpointed; a node with many neighbours meets them by `hot_join`.
    """
    e = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        n = e.count()
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("_n"))
        large = hot_join(both.where("v > u"), least, "u", "_n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        star = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        new = checkpointed(hot_join(large, down, "u", "_n", n).select(F.explode(star).alias("s")).select("s.*").where("u <> v").distinct())
        settled = new.count() == n and new.exceptAll(e).isEmpty()
        e = new
        if settled:  # stars: every node but the least of a component has one edge, to that
            return nodes.select("id").join(e.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))
