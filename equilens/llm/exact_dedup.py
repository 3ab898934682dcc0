"""Exact deduplication against a persistent index of digests, bucketed and sorted by digest.

DataFrame and SQL functions only.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.llm.common import hot_join, written

#: What the comparison ignores: space, and tab to carriage return.
BLANKS = " \t\n\v\f\r"


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_points, digest) of each row; a null text counts as empty.

    `n_points` are the code points of the text as it is, `digest` the 32 bytes of the SHA-256 of its UTF-8 without blanks.
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    dense = reduce(lambda c, blank: F.replace(c, F.lit(blank), F.lit("")), BLANKS, raw)
    return docs.select(key, F.length(raw).cast("long").alias("n_points"), F.unhex(F.sha2(dense.cast("binary"), 256)).alias("digest"))


class DigestIndex:
    """One row for each digest ever seen: the row that stays for it, and its code points.

    A table of the session's catalog at `path`, clustered and sorted by digest
    into `buckets`: a lookup reads the index side without a shuffle. Choose
    `buckets` by the rows that the index is to hold (`buckets_for`). Appends add
    a file to each bucket, which is then sorted again when it is read.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, key_type: str = "bigint", buckets: int = 64):
        if not re.fullmatch(r"\w+", name):
            raise ValueError("the index's name must be a plain identifier")
        self.spark, self.name, self.buckets = spark, name, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest binary, keep_id {key_type}, keep_points bigint) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, groups: DataFrame) -> None:
        """Appends the digests of `groups` that aren't in the index yet (sort-merge anti-join)."""
        known = self.read().select("digest").hint("merge")
        new = groups.select("digest", "keep_id", "keep_points").join(known, "digest", "left_anti")
        new.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)

    def forget(self) -> None:
        """Takes the table out of the catalog; its files stay at `path`."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def buckets_for(rows: int) -> int:
    """Buckets of about two million digests, 64 at least."""
    return max(64, -(-rows // 2_000_000))


def groups_of(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each digest: its size, and the row of most code points, then least key.

    Aggregated where the rows are before they are shuffled: a digest that a
    third of all rows share sends one row from each task.
    """
    best = F.min(F.struct((-F.col("n_points")).alias("less"), F.col(key).alias("id"))).alias("best")
    return rows.groupBy("digest").agg(best, F.count("*").alias("group_size")).select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_points"), "group_size")


def ingest(docs: DataFrame, index: DigestIndex, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Decides on `docs` against the index, then appends the new digests to it.

    Returns (key, keep_id, group_size, kept, text_sha256), one row for each row
    of `docs`. Texts are equal if they are without blanks; a null text counts as
    empty. Of the new equal texts the longest stays, then the least key (a null
    key before all others); where the index has the text from an earlier call,
    its row stays and none of the new ones does. Rows that share key and text
    are both kept if theirs is the key that stays. `group_size` counts the rows
    of this call. No documents give no rows.

    Every text is hashed once; the digests are written to the shared folder, and
    so are the groups that were decided, before the index changes: a call that
    breaks off can be repeated, as the anti-join adds nothing twice. The result
    reads both. Texts are never shuffled, and a digest that many rows share
    meets them by `hot_join`.
    """
    rows = written(digests(docs, key, text), "digests-of-rows")
    earlier = index.read().select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("old")).hint("merge")
    decided = groups_of(rows, key).join(earlier, "digest", "left")
    keep = F.when(F.col("old"), F.col("old_id")).otherwise(F.col("keep_id"))
    groups = written(decided.select("digest", keep.alias("keep_id"), "keep_points", "group_size", F.col("old").isNull().alias("new")), "digest-groups")
    index.add(groups.where("new"))
    met = hot_join(rows, groups, "digest", "group_size", rows.count())
    kept = F.col("new") & F.col("keep_id").eqNullSafe(F.col(key))
    return met.select(key, "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, row_number() OVER (PARTITION BY norm ORDER BY length(raw) DESC, doc_id) AS rn FROM t),
k AS (SELECT norm, min(CASE WHEN rn = 1 THEN doc_id END) AS keep_id, count(*) AS group_size FROM r GROUP BY norm)
SELECT r.doc_id, k.keep_id, k.group_size, r.doc_id = k.keep_id AS kept, sha256(r.norm) AS text_sha256 FROM r JOIN k USING (norm)
"""
