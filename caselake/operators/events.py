"""Canonical events, merging, pairing, dedup and intervals over event tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselake.functions.text import sha256, stable_id


def canonical_events(turns: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> typed events with ids, hashes and evidence addresses."""
    kind = F.when(F.col("role") == "user", "message.user").when(F.col("role") == "assistant", "message.agent").otherwise("message.instruction")
    actor = F.when(F.col("role") == "user", "USER").when(F.col("role") == "assistant", "PRIMARY_AGENT").otherwise("SYSTEM")
    return turns.select(
        stable_id("evt-", 24, F.col("conv_id"), F.col("turn"), kind).alias("event_id"), F.concat(F.lit("ses:generic:"), F.col("conv_id").cast("string")).alias("session_id"), F.col("turn").alias("ordinal"),
        kind.alias("kind"), actor.alias("actor_kind"), sha256(F.col("text")).alias("content_sha256"), F.concat(F.lit("case://conversations/"), F.col("conv_id").cast("string"), F.lit("#record="), F.col("turn").cast("string")).alias("evidence_uri"), "text")


def merged(rows: DataFrame, key: list[str], order: Column, first: list[str], last: list[str]) -> DataFrame:
    """Upsert semantics in one aggregation: the first or the last value that is not null, by order."""
    out = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"first_{c}") for c in first] + [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"last_{c}") for c in last]
    return rows.groupBy(*key).agg(*out)


def next_result(rows: DataFrame, key: list[str], order: list[str], call: Column, result: Column, value: str) -> DataFrame:
    """Calls, each with `value` of the first result after it under the same key, null if there is none."""
    after = Window.partitionBy(*key).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("__result", F.first(F.when(result, F.col(value)), ignorenulls=True).over(after)).where(call)


def anchored_duplicates(rows: DataFrame, key: list[str], ordinal: str, window: int) -> DataFrame:
    """rows with `duplicate`: within `window` of the last row of its key that is none itself. A duplicate does not
    move the anchor, so this is a fold; each task streams its keys in order and holds one anchor."""
    schema = rows.withColumn("duplicate", F.lit(True)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, anchor = None, 0
        for pdf in batches:
            out = []
            for k, o in zip(pdf["__key"], pdf[ordinal], strict=True):
                fresh = k != now or o - anchor > window
                if fresh:
                    now, anchor = k, o
                out.append(not fresh)
            yield pdf.drop(columns="__key").assign(duplicate=out)

    named = rows.withColumn("__key", F.to_json(F.struct(*key), {"ignoreNullFields": "false"}))  # nulls are equal to each other
    return named.repartition("__key").sortWithinPartitions("__key", ordinal).mapInPandas(run, schema)


def user_intervals(events: DataFrame) -> DataFrame:
    """User messages, each with whether an agent message follows before the next user message of its session."""
    order = Window.partitionBy("session_id").orderBy("ordinal")
    after = order.rowsBetween(1, Window.unboundedFollowing)
    user, agent = F.col("kind") == "message.user", F.col("kind") == "message.agent"
    rows = events.withColumn("next_user", F.min(F.when(user, F.col("ordinal"))).over(after)).withColumn("next_agent", F.min(F.when(agent, F.col("ordinal"))).over(after))
    state = F.when(F.col("next_agent").isNotNull() & (F.col("next_user").isNull() | (F.col("next_agent") < F.col("next_user"))), "ATTEMPTED").otherwise("REQUESTED")
    return rows.where(user).select("event_id", "session_id", "ordinal", "next_user", state.alias("state"))


def contradictions(failures: DataFrame, reports: DataFrame, fixes: DataFrame, key: list[str], order: str) -> DataFrame:
    """Pairs (failure, report) of one key, the report later, without a fix strictly between them."""
    f = failures.select(*key, F.col("id").alias("failure_id"), F.col(order).alias("failed_at"))
    r = reports.select(*key, F.col("id").alias("report_id"), F.col(order).alias("reported_at"))
    x = fixes.select(*[F.col(k).alias(f"x_{k}") for k in key], F.col(order).alias("fixed_at"))
    pairs = f.join(r, key).where("failed_at < reported_at")
    same = [F.col(k) == F.col(f"x_{k}") for k in key]
    return pairs.join(x, [*same, F.col("fixed_at") > F.col("failed_at"), F.col("fixed_at") < F.col("reported_at")], "left_anti")
