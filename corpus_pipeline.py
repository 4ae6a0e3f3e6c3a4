"""A corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Stages take (spark, docs, sf_dir), docs being a Parquet table as read; all but the last return the columns of documents.
Every stage takes rows with nulls in any column, empty and very long texts, repeated rows, further columns and an empty
table; what becomes of them is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayline.llm.common import scratch, table
from assayline.llm.exact import drop_copies
from assayline.llm.jaccard import drop_similar
from assayline.llm.mixing import mix_rows, quality_weights
from assayline.llm.packing import pack_documents
from assayline.llm.quality import keep_good
from assayline.session import ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; a null text is judged as an empty one, a tie at 0.5 stays, repeated rows are judged alike, further columns stay."""
    return keep_good(ship(spark), docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one of the largest doc_id (null is the smallest); null counts as the empty text; further columns stay."""
    return drop_copies(spark, docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group that links of similar word 5-grams hold together; documents without words, text or doc_id link with nothing and stay; further columns stay."""
    return drop_similar(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it by quality weights, 0 to 2 times; repeats are rows of their own; null text has no words, null source is a source of its own; further columns stay."""
    return mix_rows(docs, quality_weights(table(spark, sf_dir, "labels")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens; null and empty texts give the end id alone; repeated rows are packed each; further columns go."""
    return pack_documents(docs)


STAGES = [("quality_classifier", quality_classifier), ("exact_dedup", exact_dedup), ("ngram_jaccard_join", ngram_jaccard_join), ("mix_sources", mix_sources), ("best_fit_packing", best_fit_packing)]

#: The classifier and the tokenizer can't be expressed in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(ship(spark), docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
