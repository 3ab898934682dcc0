"""Deal rows to shards by jump consistent hashing, and number them in each shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one task numbers, about.
SLICE = 1_000_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key (Lamping and Veach): no table, and a key moves only into an appended shard.

    All keys of the array jump together; those that have landed leave the loop.
    """
    key = keys.astype(np.uint64)
    shard, jump = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = jump[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (shard[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))
        jump[live] = np.minimum(step, shards).astype(np.int64)
        live = live[jump[live] < shards]
    return shard


def shard_columns(key: Column, shards: int) -> Column:
    """struct<shard,grown_shard> of a key column, for `shards` and one more.

    Keys of any type are hashed to 64 bits first; null is a key of its own.
    """

    @F.pandas_udf("shard int, grown_shard int")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for keys in batches:
            hashes = keys.to_numpy(np.int64).view(np.uint64)
            now, grown = jump_hash(hashes, shards), jump_hash(hashes, shards + 1)
            yield pd.DataFrame({"shard": now.astype(np.int32), "grown_shard": grown.astype(np.int32)})

    return place.asNondeterministic()(F.xxhash64(key))  # so that it is evaluated once


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard), one row for each row of `docs`.

    Only the key decides the shard, so equal keys share one; a null text counts
    as empty. Slots are gapless from 0 in each shard. A shard's rows aren't
    brought together for that: they are cut into slices by hash, rows are
    numbered within a slice, and a slice starts where those before it end. Rows
    with the same key and text are numbered in any order. Only numbers are
    shuffled, never texts.
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slices = max(8, -(-docs.select(key).count() // SLICE))
    size, crc = (F.octet_length(raw) + F.lit(16)).cast("long"), F.crc32(raw.cast("binary"))
    rows = docs.select(key, size.alias("size"), crc.alias("text_crc32"), shard_columns(F.col(key), shards).alias("_to"))
    placed = rows.select(key, "size", "text_crc32", F.lit("key").alias("law"), "_to.*", F.pmod(F.xxhash64(key, "text_crc32"), F.lit(slices)).alias("_slice"))
    within = Window.partitionBy("shard", "_slice").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
    sizes = placed.groupBy("shard", "_slice").agg(F.count("*").alias("_n"))
    start = sizes.select("shard", "_slice", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_slice")) - F.col("_n")).alias("_start"))
    numbered = placed.withColumn("_row", F.row_number().over(within) - 1)
    return numbered.join(start, ["shard", "_slice"]).select(key, "size", "text_crc32", "law", "shard", (F.col("_start") + F.col("_row")).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id", rows_per_file: int = 500_000) -> None:
    """Writes `docs` to `path`/shard=N/; a shard of many rows is written by several tasks."""
    parts = max(1, -(-docs.count() // (shards * rows_per_file)))
    placed = docs.withColumn("shard", shard_columns(F.col(key), shards)["shard"]).withColumn("_part", F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts)))
    placed.repartition(shards * parts, "shard", "_part").drop("_part").write.mode("overwrite").partitionBy("shard").parquet(path)
