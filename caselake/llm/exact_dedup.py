"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, one row per distinct text, with the smallest id seen when
the text came in. A batch is reduced to its digests, aggregated by digest (partial sums first, so that a text with any
number of copies is one row a task before the shuffle), anti-joined with the index by a sort-merge join that reads the
index bucket by bucket without a shuffle, and what is new is appended. Everything is DataFrame functions.

Defined cases: a null text counts as the empty text; white-space runs [ \\t-\\r] count as one space; a text of white
space only is one space and differs from the empty text. A row with a null id takes part in its group, and is
the one kept only where no row of the text has an id. Of rows that repeat an id and its text all count in group_size and
one is kept. An empty batch leaves
the index as it is. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, scratch, shared_folder, stage


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


class DigestIndex:
    """Opens the index at `path`, or makes an empty one there. A path keeps the bucket count it was made with."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def add(self, digests: DataFrame) -> None:
        """digests(id, digest): appends the digests that the index lacks."""
        classes = digests.groupBy("digest").agg(F.min("id").alias("keep_id")).hint("merge")
        new = classes.join(self.rows().hint("merge").select("digest"), "digest", "left_anti")
        staged = stage(new, "digests-new")  # the index is read here and written below
        (staged.repartition(self.buckets, "digest").write.mode("append").format("parquet").option("path", self.path)
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))

    def drop(self) -> None:
        """Forgets the table's name; the files stay and can be opened again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, digest and a number that no other row has, fixed once the result is staged."""
    return df.select(F.col(id_col).cast("long").alias("id"), digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("number"))


def decisions(digests: DataFrame, index: DigestIndex) -> DataFrame:
    """digests(id, digest, number) of rows that were added before -> id, keep_id, group_size, kept, digest, one per row.

    group_size counts the rows of `digests`. Rows meet their group in a join whose both sides are shuffled by digest,
    so that Spark splits the partition of a hot text.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "number")).alias("first")
    groups = digests.groupBy("digest").agg(F.count("*").alias("group_size"), first)
    known = stage(groups.join(index.rows().select("digest", "keep_id").hint("merge"), "digest"), "digest-groups", keep=True)
    joined = digests.join(known.hint("merge"), "digest")
    kept = (F.col("number") == F.col("first.number")) & F.col("first.id").eqNullSafe(F.col("keep_id"))
    return joined.select("id", "keep_id", "group_size", kept.alias("kept"), "digest")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """Adds df to the index in `batches` ranges of rising id, and returns the decisions on all its rows. Without an
    index one is made for the call and removed with it."""
    spark, given = df.sparkSession, index is not None
    with scratch(spark):
        digests = stage(digests_of(df, id_col, text_col), "digests", keep=True)
        index = index or DigestIndex(spark, f"{shared_folder(spark)}/digest-index-{uuid.uuid4().hex}")
        low, high = digests.agg(F.min("id"), F.max("id")).first()
        low, high = low or 0, high if high is not None else 0
        step = (high - low) // batches + 1
        for k in range(batches):
            part = digests.where((F.col("id") >= low + k * step) & (F.col("id") < low + (k + 1) * step))
            index.add(part)
        index.add(digests.where("id is null"))
        out = decisions(digests, index)
    if not given:
        index.drop()
        remove(spark, [index.path])
    return out


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = exact_dedup(docs)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
