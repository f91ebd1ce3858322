"""Finding and taking in recorded sessions: listing, guards, frozen prefixes, names and children."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselake.operators.graph import neighbors

MAX_RECORD, MAX_TEXT, MAX_RATIO, MAX_CHILDREN = 64 << 20, 8 << 30, 250, 32  # fixed values
SUFFIXES = (".jsonl", ".jsonl.gz", ".jsonl.zst", ".jsonl.zstd")


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, name, size, modified of the files below a folder that have one of the suffixes, by path; contents are not
    read. Links to elsewhere are refused by `below`."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.lower("path").endswith(s)
    return rows.where(wanted).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).orderBy("path")


def below(root: str, path: str) -> str:
    """The path, if it lies below the root and no link on the way leads out of it."""
    real, base = os.path.realpath(os.path.join(root, path)), os.path.realpath(root)
    if os.path.islink(os.path.join(root, path)) or not real.startswith(base + os.sep):
        raise ValueError(f"{path} is a link or leads out of {root}")
    return real


def variants(path: str) -> list[str]:
    """The names a file may have, as given, without and with a suffix of compression."""
    bare = path
    for s in (".gz", ".zst", ".zstd"):
        bare = bare.removesuffix(s)
    return list(dict.fromkeys([path, bare, bare + ".zst", bare + ".gz"]))


def guarded(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """source, ok, reason: lines(source, byte_length) against limits on a record, on a source's text, and on its growth
    from the stored size, sizes(source, size)."""
    held = lines.groupBy("source").agg(F.max("byte_length").alias("longest"), F.sum(F.col("byte_length") + 1).alias("text"))
    rows = held.join(sizes, "source", "left")
    reason = F.when(F.col("longest") > MAX_RECORD, "record too long").when(F.col("text") > MAX_TEXT, "text too long").when(F.col("text") > MAX_RATIO * F.greatest("size", F.lit(1)), "compression ratio too high")
    return rows.select("source", reason.isNull().alias("ok"), reason.alias("reason"))


def frozen(lines: DataFrame, size: int) -> DataFrame:
    """Whole lines within the first `size` bytes: what a file held when it was looked at."""
    return lines.where(F.col("byte_offset") + F.col("byte_length") + 1 <= size)


def resolved(sessions: DataFrame, given: str) -> DataFrame:
    """Sessions whose id or native id is the one given; else those it begins, if they are one. Several are an error."""
    ids = (F.col("session_id") == given) | (F.col("native_id") == given)
    exact = sessions.where(ids).orderBy("session_id").limit(2)
    if not exact.isEmpty():
        return exact.limit(1)
    begun = sessions.where(F.col("session_id").startswith(given) | F.col("native_id").startswith(given)).orderBy("session_id").limit(2)
    if begun.count() > 1:
        raise ValueError(f"{given} begins more than one session")
    return begun


def by_name(file_rows: DataFrame, given: str) -> DataFrame:
    """The newest file whose name holds the id."""
    return file_rows.where(F.col("name").contains(given)).orderBy(F.desc("modified"), "path").limit(1)


def with_children(edges: DataFrame, root: str, limit: int = MAX_CHILDREN) -> DataFrame:
    """The session and those it led to, over edges(src, dst, type), nearest first, `limit` children at most."""
    return neighbors(edges, root, 8, "out", limit=limit + 1)


def state_sources(threads: DataFrame, spawned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """threads(id, rollout_path, updated_at_ms) and thread_spawn_edges(parent_thread_id, child_thread_id, status) as
    sources, newest first, and edges."""
    sources = threads.select(F.col("id").alias("native_id"), F.col("rollout_path").alias("path"), F.timestamp_millis("updated_at_ms").alias("modified")).orderBy(F.desc("modified"), "native_id")
    return sources, spawned.select(F.col("parent_thread_id").alias("src"), F.col("child_thread_id").alias("dst"), F.lit("SPAWNED").alias("type"), "status")


def run_log(run_id: str, started: DataFrame, counted: DataFrame) -> DataFrame:
    """One row: RUNNING until counts (name, n) are there, then COMPLETE with them."""
    held = counted.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n")))).alias("counts"), F.count("*").alias("k"))
    return started.crossJoin(held).select(F.lit(run_id).alias("run_id"), "started_at", F.when(F.col("k") > 0, "COMPLETE").otherwise("RUNNING").alias("status"), "counts")


def appended(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """rows with the new ones; a key that would stand twice is an error."""
    out = rows.unionByName(new)
    if not out.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError(f"{', '.join(key)} would not be unique")
    return out
