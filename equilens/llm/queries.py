"""The registered queries of this subpackage: thin shells around its operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.llm import bpe, centroids, decontaminate, exact_dedup, langid, license_scan, lsh_forest, passages, secrets, sharding, toxicity, url_filter, whitening
from equilens.llm.common import shared_dir, table, written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    ranks = bpe.read_ranks(path or public_tokenizers.path(VOCABULARY))
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    shared = spark.sparkContext.broadcast(ranks)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = bpe.token_table(shared.value)
        digits = [str(i) for i in range(len(token))]
        for b in batches:
            rows = b.column("ids")
            hashes = [[hashlib.sha256(",".join(map(digits.__getitem__, x)).encode()).hexdigest(), hashlib.sha256(b"".join(map(token.__getitem__, x))).hexdigest()] for x in bpe.rows_of_ids(rows)]
            columns = [b.column("doc_id"), rows.value_lengths().cast(pa.int64()), *(pa.array([h[i] for h in hashes], pa.string()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return ids.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 40)


def op5_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text")
    found = secrets.BlobLedger(spark, shared_dir(spark, "ledger")).scan(docs, rule_version=2)
    columns = secrets.digest_columns(F.col("findings"))
    return found.select(F.col("path").alias("doc_id"), *(c.alias(n) for n, c in columns.items()))


def digest_index(spark: SparkSession, rows: int) -> exact_dedup.DigestIndex:
    """A new, empty index in the shared folder."""
    path = shared_dir(spark, "digests")
    return exact_dedup.DigestIndex(spark, path.rpartition("/")[2].replace("-", "_"), path, buckets=exact_dedup.buckets_for(rows))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The decisions of a first ingest; the index stays in the shared folder, its name leaves the catalog."""
    index = digest_index(docs.sparkSession, docs.count())
    decided = exact_dedup.ingest(docs, index)
    index.forget()
    return decided


def op8_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_script_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.similarity_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.fit(pages.select("url", url_filter.seed_label(*url_filter.host_and_path(F.col("url"))).alias("label")))
    return url_filter.judge(pages, model)


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    categories = toxicity.categories_of(F.col("toxic"), F.col("quality"))
    labels = table(spark, sf_dir, "labels").select("doc_id", *(c.alias(n) for n, c in categories.items())).dropna()
    drawn = toxicity.draw(labels)  # toxicity.TRAIN_DOCS rows, about
    labelled = written(docs.join(F.broadcast(drawn), "doc_id"), "labelled")
    chain = toxicity.fit(labelled, list(categories))
    scored = toxicity.score(docs, chain)
    return scored.select("doc_id", *(f"p_{n}" for n in categories), *((F.col(f"p_{n}") >= 0.5).alias(n) for n in categories))


def op9_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), license_scan.template_table(spark))


def op11_passage_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").dropna()
    drawn = passages.draw(labels.where(~held_out), "doc_id")  # passages.TRAIN_DOCS rows, about
    model = passages.fit(docs.join(F.broadcast(drawn), "doc_id"), "quality")
    found = passages.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "passages", "attention")


def op12_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    made = whitening.whiten(vectors)
    columns = "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    if made is None:
        return vectors.limit(0).selectExpr("vec_id", "1 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    return whitening.components_of(made).withColumns({"n": F.lit(made.n).cast("long"), "identity_error": F.lit(made.identity_error)}).select(*columns)


def op13_bisectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    made = centroids.fit(vectors)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in made.centroids]
    by_cluster = {"cluster_inertia": (made.inertia, "array<long>"), "centroid_sha256": (sha, "array<string>")}
    found = centroids.assign(vectors, made)
    looked_up = {name: F.get(F.array(*map(F.lit, cells)).cast(kind), F.col("cluster")) for name, (cells, kind) in by_cluster.items()}
    return found.withColumns(looked_up | {"inertia": F.lit(sum(made.inertia)).cast("long")}).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_url_trees": op2_url_trees,
        "op3_toxicity_chain": op3_toxicity_chain,
        "op4_jump_shards": op4_jump_shards,
        "op5_blob_ledger": op5_blob_ledger,
        "op6_string_tiling": op6_string_tiling,
        "op7_lsh_forest": op7_lsh_forest,
        "op8_digest_index": op8_digest_index,
        "op9_license_dice": op9_license_dice,
        "op10_script_viterbi": op10_script_viterbi,
        "op11_passage_attention": op11_passage_attention,
        "op12_block_whitening": op12_block_whitening,
        "op13_bisectors": op13_bisectors,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_digest_index": exact_dedup.ORACLE}
