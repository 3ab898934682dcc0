"""Secret scans over an incremental ledger of blobs.

Every historical version of a file is addressed by the SHA-256 of its content;
a scan reads only the pairs of blob and rule version that the ledger lacks,
and findings are joined back to every path and version that holds the blob.
DataFrame and SQL functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equilens.llm.common import HOT, hot_join, written


@dataclass(frozen=True)
class Rule:
    """`group` must have at least `least` characters, else the match is dropped. Kinds are listed in the order of the rules."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules. Maximal runs of a class of characters that are
#: too short are left out by the pattern itself, which finds the same spans.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: What rule version 2 adds.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("token_prefix", r"\b(?:ghp|gho|ghs|ghu|glpat|xoxb|xoxp|sk_live)[_-][A-Za-z0-9_-]{16,}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = {1: BASE, 2: BASE + MORE}


FOUND = "array<struct<kind:string,start:int,end:int>>"


def matches_of(text: Column, rule: Rule, rank: int) -> Column:
    """(rank, found) of a rule with a match in the text, else null; `found` has each match's gap, the characters between it and the one before, and the lengths of match and group.

    `split` and `regexp_extract_all` walk over the same matches: the leftmost ones that don't overlap.
    """
    pattern = F.lit(rule.pattern)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    value = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else whole
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)  # one more than matches
    found = F.struct(F.lit(rank).alias("rank"), gaps.alias("gaps"), whole.alias("sizes"), value.alias("lengths"))
    return F.when(F.regexp_like(text, pattern), found)


def findings(texts: DataFrame, key: str, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, findings), a row for each key; places in code points, end exclusive, by start and then rule.

    A key stands for a text: rows with equal keys have equal texts and are
    answered once. Every rule reads a text once. Its matches become rows of
    three numbers, which a running sum over the rows of a text and rule puts
    in their places, so the work is linear in the texts and their matches.
    Only matches are shuffled, by key; texts without any are a row each.
    """
    none = F.lit(None).cast("struct<rank:int,gaps:array<int>,sizes:array<int>,lengths:array<int>>")
    per_rule = texts.select(F.col(key).alias("key"), F.explode(F.array(none, *(matches_of(F.col(text), r, i) for i, r in enumerate(rules)))).alias("m"))
    cells = F.arrays_zip(F.slice("m.gaps", 1, F.size("m.sizes")).alias("gap"), F.col("m.sizes").alias("size"), F.col("m.lengths").alias("length"))
    rows = per_rule.select("key", F.col("m.rank").alias("rank"), F.posexplode_outer(cells).alias("at", "c")).select("key", "rank", "at", "c.gap", "c.size", "c.length")
    once = rows.repartition("key").groupBy("key", "rank", "at").agg(*(F.first(c).alias(c) for c in ("gap", "size", "length")))
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("key", "rank").orderBy("at")).cast("int")
    fits = F.col("length") >= F.get(F.array(*(F.lit(r.least) for r in rules)), F.col("rank"))
    placed = once.withColumn("end", end).select("key", F.when(fits, F.struct((F.col("end") - F.col("size")).alias("start"), "rank", "end")).alias("f"))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    named = F.transform(F.sort_array(F.collect_list("f")), lambda x: F.struct(F.get(kinds, x["rank"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return placed.groupBy("key").agg(named.cast(FOUND).alias("findings")).withColumnRenamed("key", key)


class BlobLedger:
    """Scanned (blob, rule_version) pairs with the places of their findings, in folders rule_version=N below `path`.

    The ledger holds no text of a secret, only its kind and place.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    SCHEMA = f"blob binary, findings {FOUND}"

    def read(self, rule_version: int) -> DataFrame:
        """What one rule version has found; empty before its first scan. A blob that a repeated scan has written twice is there twice."""
        folder = f"{self.path}/rule_version={rule_version}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(folder)

    def scan(self, versions: DataFrame, rule_version: int, path: str = "path", version: str = "version", text: str = "text") -> DataFrame:
        """Scans the blobs of `versions` that this rule version hasn't seen, and returns (path, version, blob, findings) for all of them.

        A null text is an empty blob; null paths and versions are values like
        others, and repeated rows are answered one by one. No versions give no
        rows. Texts are hashed once, and the addresses written to the shared
        folder. Only one row of each new blob sends its text through the
        shuffle; which one is decided on addresses alone. Findings go back to
        their rows by `hot_join`, as many rows may share a blob.
        """
        raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
        address = F.unhex(F.sha2(raw.cast("binary"), 256))
        blobs = written(versions.select(path, version, address.alias("blob")), "addresses")
        first = blobs.groupBy("blob").agg(F.min(F.struct(path, version)).alias("at"), F.count("*").alias("rows"))
        unseen = first.join(self.read(rule_version).select("blob"), "blob", "left_anti")
        unseen = unseen.select(F.col(f"at.{path}").alias("_path"), F.col(f"at.{version}").alias("_version"), F.col("blob").alias("_blob"))
        same = F.col(path).eqNullSafe(F.col("_path")) & F.col(version).eqNullSafe(F.col("_version"))
        todo = versions.select(path, version, raw.alias("_text")).join(unseen.hint("shuffle_hash"), same)
        # several rows may have the same path and version, with the blob or without it
        own = todo.where(F.unhex(F.sha2(F.col("_text").cast("binary"), 256)) == F.col("_blob"))
        found = findings(own.select(F.col("_blob").alias("blob"), "_text"), "blob", "_text", RULES[rule_version])
        found.write.mode("append").parquet(f"{self.path}/rule_version={rule_version}")
        # blobs without a finding need no partner: only the others are joined back
        hits = self.read(rule_version).where(F.size("findings") > 0).groupBy("blob").agg(F.first("findings").alias("findings"))
        total = blobs.count()
        sized = blobs.groupBy("blob").agg(F.count("*").alias("rows")).join(hits, "blob", "left")
        met = hot_join(blobs, sized.where(F.col("findings").isNotNull() | (F.col("rows") * HOT > total)), "blob", "rows", total, "left")
        return met.select(path, version, F.lower(F.hex("blob")).alias("blob"), F.coalesce("findings", F.array().cast(FOUND)).alias("findings"))


def digest_columns(findings: Column) -> dict[str, Column]:
    """Counts by base kind and the joined spans, as the query returns them."""
    kinds = [r.kind for r in RULES[2]]
    rank = F.create_map(*(x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))))

    def joined(spans: Column) -> Column:
        ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))))
        return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = [r.kind for r in BASE]

    def count(kind: str) -> Column:
        return F.size(F.filter(findings, lambda x: x["kind"] == kind)).cast("long")

    counts = {f"n_{k}": count(k) for k in base}
    return counts | {"base_sha256": F.sha2(joined(F.filter(findings, lambda x: x["kind"].isin(*base))).cast("binary"), 256), "spans": joined(findings)}
