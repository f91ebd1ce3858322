"""Line-oriented JSON sources with full parse accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """source, ordinal, byte_offset, byte_length, sha256, line of every line of every file under path; .gz, .zst and
    .zstd files are decoded by suffix. Plain files may be read in splits, whose places give the order; the window is by source."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=False)
    rows = rows.select(F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("k"), F.col("_metadata.file_block_start").alias("b"), F.col("value").alias("line"))
    order = Window.partitionBy("source").orderBy("b", "k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("line").cast("long")
    return rows.select("source", F.row_number().over(order).cast("long").alias("ordinal"), F.coalesce(F.sum(size + 1).over(before), F.lit(0)).alias("byte_offset"), size.alias("byte_length"), F.sha2("line", 256).alias("sha256"), "line")


def parsed(line: Column) -> Column:
    """Whether the line is one JSON value and nothing else: it parses both inside an array and inside an object."""
    return F.try_parse_json(F.concat(F.lit("["), line, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"r":'), line, F.lit("}"))).isNotNull()


def accounted(rows: DataFrame) -> DataFrame:
    """lines() with status PARSED or UNPARSED and, for parsed lines, the value as a variant; duplicate keys are taken
    as JSON readers do, the last one, if the session allows them (spark.sql.variant.allowDuplicateKeys)."""
    ok = parsed(F.col("line"))
    return rows.withColumn("status", F.when(ok, "PARSED").otherwise("UNPARSED")).withColumn("value", F.when(ok, F.try_parse_json("line")))
