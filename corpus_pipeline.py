"""The training-data pipeline: five stages, each one of the operators of equilens.llm.

Every stage takes (spark, docs, sf_dir) and returns what it keeps of `docs`;
the result is written as Parquet and read again as the next stage's `docs`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.llm import bpe, decontaminate, langid, lsh_forest
from equilens.llm.common import removed, shared_dir, table, text_or_empty
from equilens.llm.queries import VOCABULARY, deduplicated

#: Share of a document's letters in its main language below which it is rejected.
LEAST_SCORE = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty ones too) and those without a main language.

    The model is fitted on `documents`. Repeated rows are judged one by one, and a tie between two languages is below
    the least score only if a third one has letters. No documents give none.
    """
    model = langid.fit(table(spark, sf_dir, "documents").where(~langid.held_out()))
    found = langid.identify(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the longest, then first, of the documents that are equal without blanks; null texts are equal to empty ones.

    Rows that share a key stay together if theirs is a key that stays; a null key finds no decision and goes.
    """
    decided = deduplicated(docs.select("doc_id", "text"))
    return docs.select(*COLUMNS).join(decided.where("kept").select("doc_id"), "doc_id", "left_semi").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least key, of each class that links of similarity 0.8 or more hold together.

    Texts without words are classes of their own. Rows that share the least key all stay, those with a null key go.
    """
    classes = lsh_forest.similarity_classes(docs.select("doc_id", "text"))
    return lsh_forest.one_of_each(docs.select(*COLUMNS), classes)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none. Without items all documents stay."""
    found = decontaminate.contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return docs.select(*COLUMNS).join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, and whether they decode to its text; a null text has no ids. Repeated rows are encoded one by one."""
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    text = text_or_empty()
    texts = docs.select("doc_id", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("sha"))
    decoded = bpe.round_trip(texts, ranks, public_tokenizers.PATTERN)
    same = F.sha2("decoded", 256) == F.col("sha")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: The second, third and fourth stages have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage has written is deleted when the next one has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        path = shared_dir(spark, f"pipeline-{name}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs
