"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see.

    Where the setting is missing (a local session, as in tests) a temporary
    folder is set up once; a cluster without the setting is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            top = known.get()
        elif spark.sparkContext.master.startswith("local["):
            top = "file://" + tempfile.mkdtemp(prefix="equilens-")
            spark.sparkContext.setCheckpointDir(top)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written_at(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """`df` as a Parquet table in the shared folder, and its path: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, what: str) -> DataFrame:
    return written_at(df, what)[0]


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes folders below the shared folder that no later step reads."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


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


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, str]:
    """(id, component): the least id that can be reached over the undirected edges; and the folder that it is read from.

    Alternating large-star and small-star steps: every round is two groupings
    and two joins over the edges, whose number never grows; the number of
    rounds is logarithmic in the longest chain. Each round is written to the
    shared folder, so a lost executor costs one round at most, and the round
    before is deleted. A node with many neighbours meets them by `hot_join`.
    Nothing but counts of edges comes to the driver.
    """
    spark = edges.sparkSession
    e, path = written_at(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc")
    while True:
        n = e.count()
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("_n"))
        large = hot_join(both.where("v > u"), least, "u", "_n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # large-star links a node's larger neighbours to its least neighbour; small-star the smaller ones and itself
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        star = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = hot_join(large, down, "u", "_n", n).select(F.explode(star).alias("s")).select("s.*").where("u <> v").distinct()
        small, new_path = written_at(small, "cc")
        same = small.count() == n and small.exceptAll(e).isEmpty()
        removed(spark, path)
        e, path = small, new_path
        if same:
            break
    nodes = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), path
