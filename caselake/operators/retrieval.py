"""Lexical, vector and hybrid retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselake.functions.text import cosine, tokens

FLOOR, RRF = 0.15, 60  # fixed values


def lexical(events: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """Events whose text holds every term, a term of several words as a phrase of consecutive tokens."""
    found = F.concat(F.lit(" "), F.array_join(tokens(F.col(text)), " "), F.lit(" "))
    wanted = [" ".join(t.lower().split()) for t in terms]
    cond = F.lit(True)
    for t in wanted:
        cond = cond & found.contains(f" {t} ")
    return events.where(cond)


def inverted_index(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """token, df, cf. Both counts are partial sums before they are shuffled, by token alone."""
    found = docs.select(tokens(F.col(text)).alias("t"))
    held = found.select(F.explode(F.array_distinct("t")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return held.join(found.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("cf")), "token")


def similar(vectors: DataFrame, query: DataFrame, vector: str = "embedding") -> DataFrame:
    """vectors with `similarity` to the one row of query(q), which is broadcast."""
    return vectors.crossJoin(F.broadcast(query.limit(1))).withColumn("similarity", cosine(F.col(vector), F.col("q"))).drop("q")


def fused(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Reciprocal rank fusion of (key, rank) lists."""
    a, b = left.select(key, F.col("rank").alias("rank_a")), right.select(key, F.col("rank").alias("rank_b"))
    part = lambda c: F.when(F.col(c).isNotNull(), 1 / (RRF + F.col(c))).otherwise(F.lit(0.0))
    return a.join(b, key, "full").withColumn("score", part("rank_a") + part("rank_b"))


def ranked_top(rows: DataFrame, order: list, k: int) -> DataFrame:
    """The first k by order with their rank from 1; the sort is a top-k before the window sees k rows."""
    return rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fixed_chunks(docs: DataFrame, doc: str, text: str, size: int = 1600, overlap: int = 200) -> DataFrame:
    """doc, chunk, begin, content: steps of size - overlap until the text's end is in a chunk."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    rows = docs.select(doc, text, F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return rows.select(doc, "chunk", (F.col("chunk") * step).alias("begin"), F.substring(F.col(text), F.col("chunk") * step + 1, F.lit(size)).alias("content"))


def word_chunks(docs: DataFrame, doc: str, text: str, size: int = 1600, overlap: int = 200) -> DataFrame:
    """doc, chunk, begin, content: windows that end at the last blank beyond 60 % of their size, if there is one, the
    next `overlap` before that; contents are trimmed, empty ones left out. Each window needs the end of the one
    before, so a task streams its texts; positions are code points and null texts make no chunks."""
    if not 0 <= overlap < size * 0.6:
        raise ValueError("overlap must be less than 60 % of the size")

    def cut(t: str) -> Iterator[tuple[int, str]]:
        begin = 0
        while begin < len(t):
            end = min(len(t), begin + size)
            blank = t.rfind(" ", begin, end + 1) if end < len(t) and len(t) > size else -1
            end = blank if blank > begin + int(size * 0.6) else end
            yield begin, t[begin:end].strip() if len(t) > size else t
            if end == len(t):
                return
            begin = max(begin + 1, end - overlap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = ((d, k, b, c) for d, t in zip(pdf[doc], pdf[text], strict=True) if t for k, (b, c) in enumerate(x for x in cut(t) if x[1]))
            yield pd.DataFrame(rows, columns=[doc, "chunk", "begin", "content"])

    return docs.select(doc, text).mapInPandas(run, f"`{doc}` {docs.schema[doc].dataType.simpleString()}, chunk int, begin int, content string")
