"""Ledgers of a case: tools, artifacts, tasks, claims and validations from events, and the edges between them.

An event has event_id, session_id, kind, call_id, tool, command, status, exit_code, observed_at and text; `order` is a
column that orders all events of a case (a struct of time, source, ordinal). Everything is one aggregation or one window
by call, path, session or command, so that a case of any number of sessions is spread over them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselake.functions import reading
from caselake.functions.text import stable_id

ACTIVITY = ["tool.requested", "filesystem.patch", "mcp.completed"]  # fixed values
RESULTS = ["tool.completed", "tool.observed"]
STATE_RANK = ["MISSING", "LIVE_VERIFIED", "LIVE_UNVERIFIED", "FAILED", "SUPERSEDED", "UNKNOWN"]


def keep_first(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Insert or ignore: the first row of each key."""
    return _one(rows, key, F.min_by, order)


def keep_last(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Insert or replace: the last row of each key."""
    return _one(rows, key, F.max_by, order)


def _one(rows: DataFrame, key: list[str], best, order: Column) -> DataFrame:
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(best(F.struct(*others), order).alias("__r")).select(*key, *[F.col(f"__r.{c}").alias(c) for c in others])


def last_known(col: str | Column, order: Column) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.max_by(col, F.when(col.isNotNull(), order))


def canonical(events: DataFrame) -> DataFrame:
    return events.where("canonical")


def actors(events: DataFrame, order: Column) -> DataFrame:
    """One row per actor: kind of its first event, the last role and name that are known."""
    return events.groupBy("actor_id").agg(F.min_by("actor_kind", order).alias("kind"), last_known("actor_role", order).alias("role"), last_known("actor_name", order).alias("name"))


def tools(events: DataFrame, order: Column) -> DataFrame:
    """One row per call id. What names the call is that of its first event (a result that comes before its call leaves
    it without a call event); status is the last, result, exit code and end the last known. A request without a result
    ends INCOMPLETE."""
    result = F.when(F.col("kind").isin(RESULTS), F.struct("event_id", "observed_at"))
    first = F.min_by(F.struct(F.when(F.col("kind") == "tool.requested", F.col("event_id")).alias("call_event"), "session_id", "tool", "command", F.col("observed_at").alias("started_at")), order)
    rows = events.where("call_id is not null").groupBy("call_id").agg(first.alias("f"), F.max_by("status", order).alias("s"), last_known(result, order).alias("r"), last_known("exit_code", order).alias("exit_code"))
    status = F.when((F.col("s") == "REQUESTED") & F.col("r").isNull(), "INCOMPLETE").otherwise(F.col("s"))
    fingerprint = stable_id("fp-", 24, F.col("f.tool"), F.col("f.command"))
    return rows.select("call_id", "f.*", F.col("r.event_id").alias("result_event"), F.col("r.observed_at").alias("ended_at"), "exit_code", status.alias("status"), fingerprint.alias("fingerprint"))


def observed_calls(events: DataFrame, order: Column) -> DataFrame:
    """tool.observed events, each with the latest call before it of its session and command."""
    before = Window.partitionBy("session_id", "command").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    call = F.last(F.when(F.col("kind") == "tool.requested", F.col("call_id")), ignorenulls=True).over(before)
    return events.where(F.col("kind").isin("tool.requested", "tool.observed")).withColumn("matched_call", call).where("kind = 'tool.observed'")


def repetitions(tool_rows: DataFrame, least: int = 3) -> DataFrame:
    """Calls repeated `least` times or more; terminal_status is the greatest status by name."""
    out = tool_rows.groupBy("fingerprint", "tool").agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "FAILED").alias("failures"), F.min("started_at").alias("first_at"), F.max(F.coalesce("ended_at", "started_at")).alias("last_at"), F.max("status").alias("terminal_status"))
    return out.where(F.col("attempts") >= least)


def artifacts(touches: DataFrame, order: Column) -> DataFrame:
    """touches(root, path, event_id, operation, sha256, status, observed_at) -> one row per root and path."""
    rows = touches.groupBy("root", reading.logical_path(F.col("path"), F.col("root")).alias("logical_path")).agg(
        last_known("path", order).alias("current_path"), F.max_by("status", order).alias("current_status"), last_known("sha256", order).alias("current_sha256"), F.min_by("observed_at", order).alias("first_seen"), last_known("observed_at", order).alias("last_seen"))
    return rows.select(stable_id("art-", 24, F.col("root"), F.col("logical_path")).alias("artifact_id"), reading.artifact_kind(F.col("current_path")).alias("kind"), "*")


def revisions(touches: DataFrame, order: Column) -> DataFrame:
    """One row per touch, with the revision and the producer before it."""
    path = reading.logical_path(F.col("path"), F.col("root"))
    rows = touches.withColumn("artifact_id", stable_id("art-", 24, F.col("root"), path))
    rows = rows.withColumn("revision_id", stable_id("rev-", 24, F.col("artifact_id"), F.col("event_id"), F.col("operation"), F.col("sha256")))
    w = Window.partitionBy("artifact_id").orderBy(order, "revision_id")
    return rows.withColumn("predecessor", F.lag("revision_id").over(w)).withColumn("predecessor_event", F.lag("event_id").over(w)).withColumn("number", F.row_number().over(w))


def current_state(artifact_rows: DataFrame, seen: DataFrame) -> DataFrame:
    """artifacts with the path, status and hash that a look at the workspace found, seen(artifact_id, path, sha256); one
    that was looked for and isn't there has a null hash."""
    s = seen.select("artifact_id", F.col("path").alias("__path"), F.col("sha256").alias("__sha"), F.lit(True).alias("__seen"))
    status = F.when(F.col("__seen").isNull(), F.col("current_status")).when(F.col("__sha").isNull(), "MISSING").when(F.col("__sha") == F.col("current_sha256"), "LIVE_VERIFIED").otherwise("LIVE_UNVERIFIED")
    rows = artifact_rows.join(s, "artifact_id", "left")
    return rows.withColumn("current_status", status).withColumn("current_path", F.coalesce("__path", "current_path")).withColumn("current_sha256", F.coalesce("__sha", "current_sha256")).drop("__path", "__sha", "__seen")


def by_priority(artifact_rows: DataFrame, partition: list[str]) -> DataFrame:
    """rank from 1: by state, then path."""
    place = F.array_position(F.array(*map(F.lit, STATE_RANK)), F.col("current_status"))
    w = Window.partitionBy(*partition).orderBy(F.when(place > 0, place).otherwise(11), "logical_path")
    return artifact_rows.withColumn("rank", F.row_number().over(w))


def tasks(events: DataFrame, order: Column, top: int = 1000) -> DataFrame:
    """Substantive user messages as tasks: REQUESTED, or ATTEMPTED with the last activity before the session's next
    user message, substantive or not. Priority falls from `top` in the order of each session."""
    w = Window.partitionBy("session_id").orderBy(order)
    user, active = F.col("kind") == "message.user", F.col("kind").isin(ACTIVITY)
    turn = F.count_if(user).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = events.where(user | active).withColumn("turn", turn).withColumn("request", F.when(user, reading.substantive(F.col("text"))))
    out = rows.where("turn > 0").groupBy("session_id", "turn").agg(
        F.max(F.when(user, F.struct("event_id", "request"))).alias("u"), F.max(F.when(user, order)).alias("o"), F.max_by("event_id", F.when(active, order)).alias("last_event"))
    out = out.where("u.request is not null").withColumn("priority", F.lit(top + 1) - F.row_number().over(Window.partitionBy("session_id").orderBy("o")))
    state = F.when(F.col("last_event").isNull(), "REQUESTED").otherwise("ATTEMPTED")
    return out.select(stable_id("tsk-", 16, F.col("u.event_id")).alias("task_id"), "session_id", F.col("u.event_id").alias("requested_event"), F.col("u.request").alias("request"), "last_event", "priority", state.alias("state"))


def decision_records(events: DataFrame) -> DataFrame:
    rows = events.select("event_id", "session_id", F.posexplode(reading.decisions(reading.elided(F.col("text")))).alias("position", "decision"))
    return rows.select(stable_id("dec-", 16, F.col("event_id"), F.col("position"), F.col("decision")).alias("decision_id"), "*")


def completion_claims(events: DataFrame) -> DataFrame:
    """What agents report as done."""
    rows = events.where("kind = 'message.agent'").select("event_id", "session_id", F.posexplode(reading.completions(reading.elided(F.col("text")))).alias("position", "report"))
    return rows.select(stable_id("clm-", 16, F.lit("reported-completion"), F.col("event_id"), F.col("position")).alias("claim_id"), "*")


def validations(tool_rows: DataFrame, observed: DataFrame) -> DataFrame:
    """Recorded commands that test, lint or build: observed events, and executions that no observed event of their
    session repeats."""
    key = lambda df: df.withColumn("__key", reading.command_key(F.col("session_id"), F.col("command"))).where(reading.is_validation(F.col("command")))
    seen = key(observed)
    own = key(tool_rows).join(seen.select("__key").distinct(), "__key", "left_anti")
    own = own.select(F.coalesce("result_event", "call_event").alias("event_id"), "call_id", "session_id", "command", "status", "exit_code", F.lit("historical-tool").alias("origin"))
    rows = own.unionByName(seen.select("event_id", "call_id", "session_id", "command", "status", "exit_code", F.lit("historical-observation").alias("origin")))
    return rows.select(stable_id("val-", 16, F.col("origin"), F.coalesce("event_id", "call_id")).alias("validation_id"), "event_id", "session_id", "origin", reading.validation_target(F.col("command")).alias("target"), reading.validation_status(F.col("status"), F.col("exit_code")).alias("status"))


def contradictions(reports: DataFrame, executions: DataFrame) -> DataFrame:
    """reports(claim_id, session_id, at, text) and executions(call_id, session_id, at, text, status, fingerprint) ->
    (claim_id, call_id): a report after a failed or incomplete execution that shares a stem with it, unless the same
    call succeeded between the two. Only the next success after a failure matters, so it is a window, and the join is
    by session and stem."""
    success = F.min(F.when(F.col("status") == "COMPLETED", F.col("at"))).over(Window.partitionBy("session_id", "fingerprint").orderBy("at").rowsBetween(1, Window.unboundedFollowing))
    failed = executions.withColumn("fixed", success).where(F.col("status").isin("FAILED", "INCOMPLETE"))
    failed = failed.select("call_id", "session_id", F.col("at").alias("failed_at"), "fixed", F.explode(reading.stems(F.col("text"))).alias("stem"))
    said = reports.select("claim_id", "session_id", F.col("at").alias("said_at"), F.explode(reading.stems(F.col("text"))).alias("stem"))
    pairs = said.join(failed, ["session_id", "stem"]).where((F.col("failed_at") < F.col("said_at")) & (F.col("fixed").isNull() | (F.col("fixed") >= F.col("said_at"))))
    return pairs.select("claim_id", "call_id").distinct()


def edge(df: DataFrame, src: str, dst: str, kind: Column | str) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), kind.alias("type")).where("src is not null and dst is not null")


def result_edges(tool_rows: DataFrame) -> DataFrame:
    return edge(tool_rows, "call_event", "result_event", "RESULT_OF")


def revision_edges(revision_rows: DataFrame) -> DataFrame:
    """PRODUCED for a revision that creates, else MODIFIED; SUPERSEDES from the event before to another one."""
    made = edge(revision_rows, "event_id", "artifact_id", F.when(F.upper("operation") == "CREATE", "PRODUCED").otherwise("MODIFIED"))
    return made.union(edge(revision_rows.where("predecessor_event <> event_id"), "predecessor_event", "event_id", "SUPERSEDES"))


def validation_edges(validation_rows: DataFrame) -> DataFrame:
    return edge(validation_rows, "event_id", "validation_id", "VALIDATED")


def contradiction_edges(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """pairs(failure_event, report_event); both must be events."""
    ids = events.select(F.col("event_id").alias("__id"))
    known = pairs.join(ids, F.col("failure_event") == F.col("__id"), "left_semi").join(ids, F.col("report_event") == F.col("__id"), "left_semi")
    return edge(known, "failure_event", "report_event", "CONTRADICTS").distinct()


def first_address(refs: DataFrame) -> DataFrame:
    """event_id, uri: the first available one by id."""
    return refs.where("availability = 'AVAILABLE'").groupBy("event_id").agg(F.min_by("uri", "ref_id").alias("uri"))


def addresses(refs: DataFrame) -> DataFrame:
    """event_id, uris in the order of their ids."""
    return refs.groupBy("event_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ref_id", "uri"))), lambda x: x["uri"]).alias("uris"))


def show(events: DataFrame, refs: DataFrame, edges: DataFrame, event_id: str) -> DataFrame:
    """The event with its addresses and the edges into and out of it."""
    one = events.where(F.col("event_id") == event_id)
    touching = edges.where((F.col("src") == event_id) | (F.col("dst") == event_id)).agg(F.sort_array(F.collect_list(F.struct("src", "dst", "type"))).alias("edges"))
    return one.join(addresses(refs), "event_id", "left").crossJoin(touching)


def last_rows(rows: DataFrame, partition: list[str], order: Column, n: int) -> DataFrame:
    """The last n rows of each group, in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*partition).orderBy(order.desc()))).where(F.col("__n") <= n).drop("__n")


def within_budget(sections: DataFrame, partition: list[str], order: str, text: str, budget: int = 6000) -> DataFrame:
    """Sections until their token estimates exceed the budget; what comes after the first that doesn't fit is left out."""
    used = F.sum(F.ceil(F.length(text) / 4)).over(Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return sections.withColumn("used", used.cast("long")).where(F.col("used") <= budget)


def common_folders(sessions: DataFrame, n: int = 5) -> DataFrame:
    return sessions.where("cwd is not null").groupBy("cwd").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cwd").limit(n)


def count_rows(**tables: DataFrame) -> DataFrame:
    """name, n of each table; one row a table, from partial counts."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])
