"""Sessions that are still written to: new lines as a stream, their parse accounting, counts by time, and a table of
sessions kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caselake.functions.text import moment
from caselake.sources.jsonl import accounted


def new_lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """source, line, sha256, arrived, status, value, observed_at of the lines of files that arrive below a folder."""
    rows = spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("line"), F.sha2("value", 256).alias("sha256"), F.col("_metadata.file_modification_time").alias("arrived"))
    return accounted(rows).withColumn("observed_at", moment(F.try_variant_get("value", "$.timestamp", "variant")))


def once(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each line of a source once, as long as its copies arrive within that time of each other."""
    return lines.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["source", "sha256"])


def counts(lines: DataFrame, width: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Lines by status and window of time; a window is final when no line may come late for it."""
    return lines.where("observed_at is not null").withWatermark("observed_at", late).groupBy(F.window("observed_at", width).alias("window"), "status").agg(F.count("*").alias("n"))


def appended(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes all that is there and ends; run again, it takes what came since."""
    return lines.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
