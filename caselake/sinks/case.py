"""A case on disk: canonical lines, blobs by content, tables, views. A case is written beside its place and moved there
when whole; its manifest is written last and says COMPLETE."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselake.functions import reading

INLINE = 16 << 10  # fixed value: bytes of a blob that is kept in its row


def canonical_lines(lines: DataFrame, path: str) -> None:
    """Lines by source with their ordinals; one source's lines are sorted, sources are spread."""
    lines.select("source", "ordinal", "line").repartition("source").sortWithinPartitions("source", "ordinal").write.mode("errorifexists").parquet(path)


def blobs(texts: DataFrame, text: str = "text", suffix: str = "txt") -> DataFrame:
    """sha256, byte_length, storage, body, suffix: each content once; short ones are INLINE, others EXTERNAL."""
    body = F.col(text).cast("binary")
    rows = texts.where(F.col(text).isNotNull()).select(F.sha2(body, 256).alias("sha256"), F.octet_length(text).cast("long").alias("byte_length"), body.alias("body")).dropDuplicates(["sha256"])
    return rows.withColumn("storage", F.when(F.col("byte_length") <= INLINE, "INLINE").otherwise("EXTERNAL")).withColumn("suffix", F.lit(suffix))


def ndjson(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def timeline(events: DataFrame, refs: DataFrame) -> DataFrame:
    """session_id, ordinal, value: a Markdown line an event, with its label and addresses."""
    uris = refs.groupBy("event_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ref_id", "uri"))), lambda x: x["uri"]), ", ").alias("uris"))
    rows = events.join(uris, "event_id", "left")
    line = F.concat(F.lit("- **"), reading.label(F.col("event_id")), F.lit("** `"), reading.escaped(F.col("kind")), F.lit("` "), reading.quoted(F.col("text")), F.coalesce(F.concat(F.lit(" — "), F.col("uris")), F.lit("")))
    return rows.select("session_id", "ordinal", line.alias("value"))


def receipt_text(found: dict[str, object], counts: dict[str, int]) -> str:
    lines = ["# Session receipt", "", *(f"- **{k}:** {n}" for k, n in counts.items()), f"- **Continuation readiness:** {found['readiness']}", f"- **Confidence:** {found['confidence']}", "", "## Attention required", ""]
    return "\n".join([*lines, *([f"- {a}" for a in found["anomalies"]] or ["- Nothing of note in the evidence at hand."]), ""])


def write_case(spark: SparkSession, path: str, tables: dict[str, DataFrame], manifest: dict[str, object]) -> None:
    """All tables, then the manifest, in a folder beside `path` that takes its name at the end."""
    jvm, staged = spark._jvm, f"{path}.{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{staged}/{name}")
    spark.createDataFrame([(json.dumps(manifest | {"status": "COMPLETE"}, sort_keys=True),)], "value string").coalesce(1).write.text(f"{staged}/manifest")
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) or not fs.rename(jvm.org.apache.hadoop.fs.Path(staged), target):
        fs.delete(jvm.org.apache.hadoop.fs.Path(staged), True)
        raise FileExistsError(path)


def read_manifest(spark: SparkSession, path: str) -> dict[str, object]:
    found = json.loads(spark.read.text(f"{path}/manifest").first().value)
    if found.get("status") != "COMPLETE":
        raise ValueError(f"{path} is not complete")
    return found


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    read_manifest(spark, path)
    return spark.read.parquet(f"{path}/{name}")
