"""Tables written on the way: they cut lineage, survive lost executors and go when the work around them ends."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER: list[str] = []
_SCRATCH: ContextVar[tuple[list[str], list[str]] | None] = ContextVar("scratch", default=None)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local master gets a folder of this process's own; on
    a cluster, whose executors share no such folder, the setting is asked for."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="caselake-"))
        atexit.register(shutil.rmtree, _OWN_FOLDER[0], ignore_errors=True)
    return "file://" + _OWN_FOLDER[0]


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there, and a lost executor costs
    no recomputation before it. Inside `scratch` it goes when the block ends; `keep`: when the next outer one does."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # the shuffles of this write are read no more after it
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    made = _SCRATCH.get()
    if made is not None:
        made[1 if keep else 0].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the stage tables made inside when it ends, but those to keep, which pass to the block around it."""
    outer, made = _SCRATCH.get(), ([], [])
    token = _SCRATCH.set(made)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        remove(spark, made[0])
        if outer is not None:
            outer[0].extend(made[1])


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
