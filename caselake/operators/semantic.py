"""Chunks, their embeddings by any provider, and exact nearest neighbours in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselake.functions import reading
from caselake.operators.retrieval import FLOOR, word_chunks

IDENTITY = ("provider", "model", "revision", "digest", "dimensions", "metric", "pooling", "normalization", "quantization", "runtime")  # fixed values


class Provider(Protocol):
    """What makes vectors of texts. identity has IDENTITY's fields; one whose identity differs from a projection's may
    not search it."""

    identity: dict[str, object]

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingProvider:
    """Counts of hashed terms, of length 1: for tests and where no model is at hand."""

    def __init__(self, dimensions: int = 64):
        self.identity = dict.fromkeys(IDENTITY, "none") | {"provider": "hashing", "model": "terms", "dimensions": dimensions, "metric": "cosine", "normalization": "l2"}

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in texts:
            v = np.zeros(int(self.identity["dimensions"]))
            for w in t.lower().split():
                v[zlib.crc32(w.encode()) % len(v)] += 1
            out.append((v / (np.linalg.norm(v) or 1)).tolist())
        return out


def checked_identity(provider: Provider, projection: dict[str, object] | None = None) -> dict[str, object]:
    missing = [k for k in IDENTITY if provider.identity.get(k) in (None, "")]
    if missing:
        raise ValueError(f"the provider's identity lacks {', '.join(missing)}")
    if projection is not None and any(projection.get(k) != provider.identity[k] for k in IDENTITY):
        raise ValueError("the provider is not the one that made the projection")
    return {k: provider.identity[k] for k in IDENTITY}


def checked_vectors(vectors: list[list[float]], texts: int, dimensions: int) -> list[list[float]]:
    if len(vectors) != texts:
        raise ValueError(f"{texts} texts gave {len(vectors)} vectors")
    for v in vectors:
        if len(v) != dimensions or not all(math.isfinite(x) for x in v):
            raise ValueError("a vector is not finite or of the wrong length")
    return vectors


def chunks(events: DataFrame, refs: DataFrame, size: int = 1600, overlap: int = 200) -> DataFrame:
    """Chunks of canonical events that have text and an available address, with the content's hash."""
    from caselake.operators.ledger import first_address

    rows = events.where("canonical").withColumn("__text", reading.search_text(F.col("text"))).where(F.col("__text") != "")
    rows = rows.join(first_address(refs), "event_id")
    cut = word_chunks(rows, "event_id", "__text", size, overlap)
    out = cut.join(rows.drop("text", "__text"), "event_id")
    return out.withColumn("content_sha256", F.sha2("content", 256)).withColumn("chunk_id", F.concat_ws(":", "event_id", F.col("chunk").cast("string")))


def batches(texts: list[str], items: int = 16, chars: int = 24_000) -> Iterator[list[str]]:
    """Greedy batches of at most so many texts and characters; a longer text is a batch of its own."""
    now, used = [], 0
    for t in texts:
        if now and (len(now) == items or used + len(t) > chars):
            yield now
            now, used = [], 0
        now.append(t)
        used += len(t)
    if now:
        yield now


def embedded(chunk_rows: DataFrame, provider: Provider) -> DataFrame:
    """content_sha256, occurrences, vector: each different content once."""
    dimensions = int(checked_identity(provider)["dimensions"])
    distinct = chunk_rows.groupBy("content_sha256").agg(F.min("content").alias("content"), F.count("*").alias("occurrences"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            vectors = [v for b in batches(pdf["content"].tolist()) for v in checked_vectors(provider.embed(b), len(b), dimensions)]
            yield pd.DataFrame({"content_sha256": pdf["content_sha256"], "occurrences": pdf["occurrences"], "vector": vectors})

    return distinct.mapInPandas(run, "content_sha256 string, occurrences long, vector array<double>")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, floor: float | None = FLOOR, key: str = "id", vector: str = "vector", block: int = 2048) -> DataFrame:
    """query, id, similarity, rank: for each row of queries its k nearest vectors by cosine, rounded to 9 digits, ties
    by id. Both sides go in blocks; a pair of blocks is one product of matrices and gives k rows a query."""

    def packed(df: DataFrame, name: str, parts: int) -> DataFrame:
        rows = df.select(F.col(key).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(parts)).alias("b"))
        return rows.groupBy("b").agg(F.collect_list("i").alias(f"{name}_ids"), F.flatten(F.collect_list("v")).alias(f"{name}_values")).drop("b")

    size = lambda df: max(1, -(-df.count() // block))
    pairs = packed(vectors, "v", size(vectors)).repartition(size(vectors)).crossJoin(packed(queries, "q", size(queries)))  # blocks, not rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def unit(ids, values):
            m = np.asarray(values, float).reshape(len(ids), -1)
            return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

        for pdf in frames:
            for vi, vv, qi, qv in pdf.itertuples(index=False):
                ids, near = np.asarray(vi, np.int64), np.round(unit(qi, qv) @ unit(vi, vv).T, 9)
                for q, s in zip(qi, near, strict=True):
                    best = np.lexsort((ids, -s))[:k]
                    best = best if floor is None else best[s[best] >= floor]
                    yield pd.DataFrame({"query": np.full(len(best), q, np.int64), "id": ids[best], "similarity": s[best]})

    found = pairs.mapInPandas(run, "query long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def best_per_event(hits: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """hits(content_sha256, similarity) fanned out to chunks, each event with its nearest one."""
    rows = hits.join(chunk_rows, "content_sha256")
    return rows.groupBy("event_id").agg(F.max_by(F.struct("chunk_id", "similarity"), F.struct("similarity", "chunk_id")).alias("b")).select("event_id", "b.*")


def latest(projections: DataFrame) -> DataFrame:
    """The newest projection that is COMPLETE."""
    return projections.where("status = 'COMPLETE'").orderBy(F.desc("created_at"), F.desc("projection_id")).limit(1)


def coverage_gaps(chunk_rows: DataFrame) -> list[str]:
    return ["the projection holds no chunks"] if chunk_rows.isEmpty() else []
