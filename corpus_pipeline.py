"""A corpus pipeline of five operators; each stage reads what the one before it wrote.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the packed pieces with their
ids. Rows are dropped by the quality classifier (those it rejects) and by the n-gram join (all but the first of each
group of near copies); the line and suffix stages shorten texts and keep all rows. A stage removes the tables it makes
on its way, but the small one that its result is joined with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselake.llm import line_dedup, ngram_join, packing, quality_crf, suffix_dedup
from caselake.llm.common import scratch, stage


def recounted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score at or above the threshold."""
    model = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_crf.accepted(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first of equal or nearly equal lines."""
    return recounted(line_dedup.clean(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at 0.8 or more, the one with the smallest id.
    Documents without words are no copies of each other and stay."""
    return ngram_join.firsts(docs, words=5, percent=80)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out what lies in 200-byte strings that occur more than once, every occurrence, as the operator does."""
    return recounted(suffix_dedup.clean(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every id of every document in windows of 4096; the ids stay with their pieces."""
    return packing.pack(stage(packing.pieces(docs).withColumn("ids_crc32", F.crc32("ids")), "pieces", keep=True))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark):
        for k, (name, step) in enumerate(STAGES):
            docs = stage(step(spark, docs, sf_dir), name, keep=k == len(STAGES) - 1)
    return docs


#: The classifier is trained, so no stage after it can be put in SQL.
ORACLE_SQL = None
