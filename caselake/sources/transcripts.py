"""Transcript records of three harness families as typed events, sessions, artifacts and session edges.

A family is a list of cases, each a condition on the record and the event it makes; the first that holds wins. Records
are variants, so one pass without Python reads all families, and what no case knows is kept as an unknown record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselake.functions import text as fn
from caselake.functions.variants import at, content_text, given, items, json_of, keys, kind_of, let, output_status, raw, string_at, text_of, unwrapped

# Fixed values.
CODEX_TYPES = ("session_meta", "turn_context", "world_state", "response_item", "event_msg", "token_usage_record", "realtime_item", "inter_agent_communication_metadata", "compacted")
CLAUDE_TYPES = ("user", "assistant", "system", "progress", "summary", "file-history-snapshot")
PATH_KEYS = ("file_path", "path", "notebook_path", "target_file", "filename")
WRITING_TOOLS = "write|edit|multiedit|notebookedit|apply_patch"
COMMAND_SEPARATOR = "\n--- parsed command ---\n"

FIELDS = ("kind", "subtype", "actor_id", "actor_kind", "input", "output", "status", "call_id", "native_id", "turn_id", "phase", "tool_name")
ARTIFACTS = "array<struct<path:string,operation:string>>"
EDGES = "array<struct<parent:string,child:string,type:string>>"
#: Actor id and kind by a short name; others are made with actor().
ACTORS = {"user": ("act:user", "USER"), "agent": ("act:agent:primary", "PRIMARY_AGENT"), "tool": ("act:tool:unknown", "TOOL"), "patch": ("act:tool:apply_patch", "TOOL"), "exec": ("act:tool:exec", "TOOL")}

Event = Column
Case = tuple[Column, Event]


def event(kind: str | Column, who: str | tuple[Column, str] = "codex", artifacts: Column | None = None, edges: Column | None = None, **fields: str | Column | None) -> Event:
    actor_id, actor_kind = who if isinstance(who, tuple) else ACTORS.get(who, (f"act:harness:{who}", "SYSTEM"))
    given_fields = {"kind": kind, "actor_id": actor_id, "actor_kind": actor_kind, "input": "", "output": "", **fields}
    columns = [(x if isinstance(x := given_fields.get(f), Column) else F.lit(x)).cast("string").alias(f) for f in FIELDS]
    listed = [F.coalesce(F.array().cast(t) if x is None else x.cast(t), F.array().cast(t)).alias(n) for x, t, n in ((artifacts, ARTIFACTS, "artifacts"), (edges, EDGES, "edges"))]
    return F.struct(*columns, *listed)


def first_of(cases: list[Case], otherwise: Event) -> Event:
    chain = F
    for condition, made in cases:
        chain = chain.when(condition, made)
    return chain.otherwise(otherwise)


def actor(prefix: str, name: Column, kind: str) -> tuple[Column, str]:
    return F.concat(F.lit(prefix), F.coalesce(name, F.lit("unknown"))), kind


def edge(parent: Column, child: Column, kind: Column) -> Column:
    """One session edge, none where the child or the parent is unknown."""
    return F.when(child.isNotNull() & parent.isNotNull(), F.array(F.struct(parent, child, kind)).cast(EDGES)).otherwise(F.array().cast(EDGES))


def tool_artifacts(name: Column, value: Column) -> Column:
    """Files named in the arguments of a tool that writes."""
    operation = F.when(F.lower(name).contains("write"), "CREATE_OR_REPLACE").otherwise("UPDATE")
    paths = let(unwrapped(value), lambda v: F.array_distinct(F.array_compact(F.array(*[string_at(v, f"$.{k}") for k in PATH_KEYS]))))
    return F.when(F.lower(name).rlike(WRITING_TOOLS), F.transform(paths, lambda p: F.struct(p, operation)).cast(ARTIFACTS)).otherwise(F.array().cast(ARTIFACTS))


def changed_files(changes: Column) -> Column:
    """Files of a map of path to change."""
    return F.transform(F.map_entries(at(changes, "$", "map<string,variant>")), lambda e: F.struct(e["key"], F.upper(F.coalesce(string_at(e["value"], "$.type"), F.lit("update")))))


def streams(v: Column) -> Column:
    """Standard output, and standard error on a line after it."""
    err = F.coalesce(at(v, "$.stderr"), F.lit(""))
    return F.concat(F.coalesce(at(v, "$.stdout"), F.lit("")), F.when(err != "", F.concat(F.lit("\n"), err)).otherwise(""))


def codex_item(p: Column, i: Column, session: Column) -> Event:
    kind, name, status = at(i, "$.type"), at(i, "$.tool"), at(i, "$.status")
    common = {"native_id": at(i, "$.id"), "turn_id": at(p, "$.turn_id"), "subtype": F.concat(F.lit("item_completed."), kind)}
    said = {**common, "input": content_text(given(i, "$.content")), "phase": at(i, "$.phase")}
    parsed = F.array_join(F.array_compact(F.transform(items(given(i, "$.parsed_cmd")), lambda c: at(c, "$.cmd"))), COMMAND_SEPARATOR)
    argv = given(i, "$.command")
    spoken = let(argv, lambda a: F.when(kind_of(a).startswith("ARRAY"), F.array_join(F.transform(items(a), raw), " ")).otherwise(text_of(a)))
    summary = given(i, "$.summary_text", "$.raw_content")
    done = (F.lower(F.coalesce(status, F.lit(""))) == "completed") & ~F.coalesce(at(i, "$.result.isError", "boolean"), F.lit(False))
    thread = F.coalesce(at(p, "$.thread_id"), session)
    made = F.when(done & name.isin("create_thread", "fork_thread"), F.transform(fn.thread_ids(json_of(given(i, "$.result"))), lambda c: F.struct(thread, c, F.when(name == "fork_thread", "FORKED").otherwise("DELEGATED_TASK"))).cast(EDGES))
    child, extension = at(i, "$.agent_thread_id"), F.coalesce(at(i, "$.kind"), F.lit("extension"))
    coordination = F.to_json(F.struct(at(i, "$.sender_thread_id").alias("senderThreadId"), given(i, "$.receiver_thread_ids").alias("receiverThreadIds"), given(i, "$.receiver_agents").alias("receiverAgents")))
    return first_of([
        (kind == "UserMessage", event("message.user", "user", **said)),
        (kind == "AgentMessage", event("message.agent", "agent", **said)),
        (kind == "Reasoning", event("reasoning.summary", "agent", **common | {"input": text_of(summary), "status": F.when(text_of(summary) != "", "AVAILABLE").otherwise("UNAVAILABLE")})),
        (kind == "CommandExecution", event("tool.observed", "exec", **common | {"input": F.when(parsed != "", parsed).otherwise(spoken), "output": F.coalesce(at(i, "$.aggregated_output"), streams(i)),
            "status": F.upper(F.coalesce(status, F.when(at(i, "$.exit_code", "double") == 0, "completed").otherwise("failed"))), "tool_name": "exec"})),
        (kind == "McpToolCall", event("mcp.observed", actor("act:mcp:", at(i, "$.server"), "MCP"), edges=made, **common | {"subtype": F.coalesce(name, common["subtype"]),
            "input": F.coalesce(json_of(given(i, "$.arguments")), F.lit("{}")), "output": text_of(given(i, "$.result")), "status": F.when(done, "COMPLETED").otherwise("FAILED"), "call_id": at(i, "$.id"), "tool_name": F.coalesce(name, F.lit("unknown"))})),
        (kind == "FileChange", event("filesystem.patch", "patch", artifacts=changed_files(given(i, "$.changes")), **common | {"input": F.to_json(keys(given(i, "$.changes"))), "output": streams(i),
            "status": F.upper(F.coalesce(status, F.lit("completed"))), "tool_name": "apply_patch"})),
        (kind == "ContextCompaction", event("session.compacted", **common | {"status": "OBSERVED"})),
        (kind == "FunctionCallOutput", event("tool.observed", actor("act:tool:", at(i, "$.name"), "TOOL"), **common | {"output": text_of(given(i, "$.output")), "status": output_status(given(i, "$.output")), "tool_name": F.coalesce(at(i, "$.name"), F.lit("unknown"))})),
        (kind == "ImageView", event("external.image_view", (F.lit("act:tool:image_view"), "TOOL"), **common | {"input": F.coalesce(at(i, "$.path"), F.lit("")), "status": "OBSERVED"})),
        (kind == "SubAgentActivity", event("external.subagent", actor("act:subagent:", F.coalesce(child, at(i, "$.agent_path")), "SUBAGENT"), edges=edge(thread, child, F.lit("SPAWNED")), **common | {"subtype": F.coalesce(at(i, "$.kind"), F.lit("activity")),
            "status": F.upper(F.coalesce(at(i, "$.kind"), F.lit("observed")))})),
        (kind == "CollabAgentToolCall", event("external.collaboration", (F.lit("act:tool:collaboration"), "TOOL"), **common | {"subtype": F.coalesce(name, F.lit("collaboration")), "input": coordination,
            "output": F.coalesce(json_of(given(i, "$.agents_states")), F.lit("{}")), "status": F.upper(F.coalesce(status, F.lit("observed"))), "tool_name": F.coalesce(name, F.lit("collaboration"))})),
        (kind == "Extension", event("external.extension", actor("act:service:", extension, "SERVICE"), **common | {"subtype": extension, "input": F.coalesce(at(i, "$.query"), json_of(given(i, "$.action")), F.lit("{}")),
            "output": F.coalesce(json_of(given(i, "$.results")), F.lit("[]")), "status": "COMPLETED", "tool_name": extension})),
    ], event("forensic.unknown_record", subtype=F.concat(F.lit("event_msg.item_completed."), F.coalesce(kind, F.lit("unknown"))), status="PRESERVED", native_id=common["native_id"], turn_id=common["turn_id"]))


def codex_response(p: Column) -> Event:
    kind, call = at(p, "$.type"), F.coalesce(at(p, "$.call_id"), at(p, "$.id"))
    role = F.coalesce(at(p, "$.role"), F.when(kind == "agent_message", "assistant").otherwise("unknown"))
    said = {"subtype": kind, "input": content_text(given(p, "$.content")), "native_id": at(p, "$.id"), "phase": at(p, "$.phase")}
    name, given_input = F.concat_ws(".", F.nullif(at(p, "$.namespace"), F.lit("")), at(p, "$.name")), given(p, "$.arguments", "$.input")
    summary = content_text(given(p, "$.summary"))
    message = kind.isin("message", "agent_message")
    return first_of([
        (message & (role == "user"), event("message.user", "user", **said)),
        (message & (role == "assistant"), event("message.agent", "agent", **said)),
        (message, event("message.instruction", (F.concat(F.lit("act:system:"), role), "SYSTEM"), **said)),
        (kind.isin("function_call", "custom_tool_call"), event("tool.requested", "agent", artifacts=tool_artifacts(name, given_input), subtype=kind, input=F.coalesce(raw(given_input), F.lit("")),
            status=F.coalesce(at(p, "$.status"), F.lit("REQUESTED")), native_id=at(p, "$.id"), call_id=call, tool_name=F.when(name != "", name).otherwise("unknown"))),
        (kind.isin("function_call_output", "custom_tool_call_output"), event("tool.completed", "tool", subtype=kind, output=text_of(given(p, "$.output")), status=output_status(given(p, "$.output")), call_id=at(p, "$.call_id"))),
        (kind == "reasoning", event("reasoning.summary", "agent", subtype="model_exposed_summary", input=summary, status=F.when(summary != "", "AVAILABLE").otherwise("UNAVAILABLE"))),
    ], event("forensic.unknown_record", subtype=F.concat(F.lit("response_item."), F.coalesce(kind, F.lit("unknown"))), status="PRESERVED"))


def codex_message(p: Column, i: Column, session: Column) -> Event:
    kind, call = at(p, "$.type"), at(p, "$.call_id")
    said, result = F.coalesce(at(p, "$.message"), F.lit("")), given(p, "$.result")
    failed = F.greatest(*[~F.coalesce(at(result, f"$.{x}"), F.lit("false")).isin("false", "0", "") for x in ("Err", "error", "isError")])
    server, child = F.coalesce(at(p, "$.invocation.server"), at(p, "$.app_name")), at(p, "$.agent_thread_id")
    service = {"web_search": ("act:tool:web_search", "SERVICE"), "image": ("act:tool:image_generation", "SERVICE")}
    saved = F.when(at(p, "$.saved_path").isNotNull(), F.array(F.struct(at(p, "$.saved_path"), F.lit("CREATE"))).cast(ARTIFACTS)).otherwise(F.array().cast(ARTIFACTS))
    return first_of([
        (kind == "item_completed", codex_item(p, i, session)),
        (kind == "user_message", event("message.user", "user", subtype="event_msg", input=said)),
        (kind == "agent_message", event("message.agent", "agent", subtype="event_msg", input=said, phase=at(p, "$.phase"))),
        (kind == "mcp_tool_call_end", event("mcp.completed", actor("act:mcp:", server, "MCP"), subtype=F.coalesce(at(p, "$.action_name"), at(p, "$.invocation.tool")), input=F.coalesce(json_of(given(p, "$.invocation.arguments")), F.lit("{}")),
            output=F.coalesce(json_of(result), F.lit("{}")), status=F.when(failed, "FAILED").otherwise("COMPLETED"), call_id=call, tool_name=F.coalesce(at(p, "$.invocation.tool"), at(p, "$.action_name"), F.lit("unknown")))),
        (kind == "patch_apply_end", event("filesystem.patch", "patch", artifacts=changed_files(given(p, "$.changes")), subtype="apply_patch", input=F.to_json(keys(given(p, "$.changes"))), output=streams(p),
            status=F.when(F.coalesce(at(p, "$.success", "boolean"), F.lit(False)), "COMPLETED").otherwise("FAILED"), call_id=call, turn_id=at(p, "$.turn_id"), tool_name="apply_patch")),
        (kind == "sub_agent_activity", event("external.subagent", actor("act:subagent:", F.coalesce(child, at(p, "$.agent_path")), "SUBAGENT"), edges=edge(session, child, F.lit("SPAWNED")),
            subtype=F.coalesce(at(p, "$.kind"), F.lit("activity")), status=F.coalesce(at(p, "$.kind"), F.lit("OBSERVED")), native_id=at(p, "$.event_id"))),
        (kind == "web_search_end", event("tool.completed", service["web_search"], subtype="web_search", input=F.coalesce(at(p, "$.query"), json_of(given(p, "$.action")), F.lit("{}")), status="COMPLETED", call_id=call, tool_name="web_search")),
        (kind == "image_generation_end", event("tool.completed", service["image"], artifacts=saved, subtype="image_generation", input=F.coalesce(at(p, "$.revised_prompt"), F.lit("")), output=F.coalesce(json_of(result), F.lit("{}")),
            status=F.upper(F.coalesce(at(p, "$.status"), F.lit("COMPLETED"))), call_id=call, tool_name="image_generation")),
        (kind.isin("task_started", "task_complete"), event(F.concat(F.lit("session."), kind), subtype=kind, status=F.when(kind == "task_complete", "COMPLETED").otherwise("STARTED"),
            turn_id=at(p, "$.turn_id"), output=F.coalesce(at(p, "$.last_agent_message"), F.lit("")))),
        (kind == "context_compacted", event("session.compacted", subtype="event_msg", status="OBSERVED")),
        (kind == "thread_settings_applied", event("session.settings", subtype=kind, input=F.coalesce(json_of(given(p, "$.thread_settings")), F.lit("{}")), status="APPLIED")),
        (kind == "token_count", event("telemetry.token_count", subtype=kind, status="OBSERVED")),
    ], event("forensic.unknown_record", subtype=F.concat(F.lit("event_msg."), F.coalesce(kind, F.lit("unknown"))), status="PRESERVED"))


def codex(r: Column, p: Column, i: Column, session: Column) -> Event:
    """Of a record, its payload and the payload's item."""
    kind = at(r, "$.type")
    parent, own = F.coalesce(at(p, "$.parent_thread_id"), at(p, "$.forked_from_id")), F.coalesce(at(p, "$.session_id"), at(p, "$.id"), session)
    spoken, role = at(p, "$.type") == "transcript_segment", at(p, "$.role")
    live = {"subtype": F.coalesce(at(p, "$.type"), F.lit("unknown")), "native_id": at(p, "$.id")}
    return first_of([
        (kind == "session_meta", event("session.meta", subtype="codex", status="OBSERVED", edges=edge(parent, own, F.when(at(p, "$.forked_from_id").isNotNull(), "FORKED").otherwise("CHILD")))),
        (kind == "turn_context", event("session.turn_context", subtype="codex", status="OBSERVED", turn_id=at(p, "$.turn_id"), input=F.coalesce(at(p, "$.summary"), F.lit("")))),
        (kind == "world_state", event("session.world_state", subtype="codex", status="OBSERVED")),
        (kind == "response_item", codex_response(p)),
        (kind == "event_msg", codex_message(p, i, session)),
        (kind == "compacted", event("session.compacted", subtype="replacement_history", input=F.coalesce(raw(given(p, "$.replacement_history")), F.lit("")), status="OBSERVED")),
        (kind == "token_usage_record", event("telemetry.token_usage", subtype=kind, status="OBSERVED", turn_id=at(p, "$.turn_id"))),
        ((kind == "realtime_item") & spoken & (role == "user"), event("realtime.transcript", "user", **live, input=F.coalesce(at(p, "$.text"), F.lit("")))),
        ((kind == "realtime_item") & spoken, event("realtime.transcript", "agent", **live, input=F.coalesce(at(p, "$.text"), F.lit("")))),
        (kind == "realtime_item", event("realtime.session", **live, status=F.coalesce(at(p, "$.outcome"), F.when(at(p, "$.type") == "realtime_session_closed", "CLOSED").otherwise("OBSERVED")))),
        (kind == "inter_agent_communication_metadata", event("telemetry.inter_agent", subtype=kind, status="OBSERVED")),
    ], event("forensic.unknown_record", subtype=F.coalesce(kind, F.lit("unknown")), status="PRESERVED"))


def claude(r: Column) -> Column:
    """An array: a message makes one event for each of its blocks."""
    kind, uuid = at(r, "$.type"), at(r, "$.uuid")
    role, content = F.coalesce(at(r, "$.message.role"), kind), given(r, "$.message.content", "$.content")

    def block(b: Column) -> Event:
        t, said = at(b, "$.type"), {"subtype": "claude", "input": F.coalesce(at(b, "$.text"), F.lit("")), "native_id": uuid}
        return first_of([
            ((t == "text") & (role == "user"), event("message.user", "user", **said)),
            (t == "text", event("message.agent", "agent", **said)),
            (t == "tool_use", event("tool.requested", "agent", artifacts=tool_artifacts(at(b, "$.name"), given(b, "$.input")), subtype="claude.tool_use", input=F.coalesce(json_of(given(b, "$.input")), F.lit("{}")),
                call_id=at(b, "$.id"), native_id=uuid, tool_name=F.coalesce(at(b, "$.name"), F.lit("unknown")))),
            (t == "tool_result", event("tool.completed", "tool", subtype="claude.tool_result", output=text_of(given(b, "$.content")), status=F.when(F.coalesce(at(b, "$.is_error", "boolean"), F.lit(False)), "FAILED").otherwise("COMPLETED"),
                call_id=at(b, "$.tool_use_id"), native_id=uuid)),
        ], F.lit(None))

    listed = kind_of(content).startswith("ARRAY")
    plain = event(F.when(role == "user", "message.user").otherwise("message.agent"), (F.when(role == "user", "act:user").otherwise("act:agent:primary"), F.when(role == "user", "USER").otherwise("PRIMARY_AGENT")),
                  subtype="claude", input=text_of(content), native_id=uuid)
    blocks = F.filter(F.transform(items(content), block), lambda e: e.isNotNull())
    empty = event("forensic.unknown_record", "claude", subtype=F.concat(F.lit("claude."), kind, F.lit(".empty")), status="PRESERVED")
    files = F.coalesce(keys(given(r, "$.snapshot.trackedFileBackups", "$.trackedFileBackups")), F.array().cast("array<string>"))
    compact = (kind == "system") & (F.coalesce(at(r, "$.subtype"), F.lit("")).contains("compact") | given(r, "$.compactMetadata").isNotNull())
    rest = F.when(kind == "progress", "external.hook").otherwise("forensic.unknown_record")
    single = first_of([
        ((kind == "summary") | F.coalesce(at(r, "$.isCompactSummary", "boolean"), F.lit(False)), event("session.compacted", "claude", subtype="claude.summary", input=text_of(given(r, "$.summary", "$.message", "$.content")), status="OBSERVED")),
        (kind == "file-history-snapshot", event("filesystem.snapshot", "claude", artifacts=F.transform(files, lambda f: F.struct(f, F.lit("SNAPSHOT"))), subtype="claude.file-history", status="OBSERVED")),
        (compact, event("session.compacted", "claude", subtype=F.coalesce(at(r, "$.subtype"), F.lit("claude.system")), input=text_of(given(r, "$.content", "$.message")), status="OBSERVED")),
    ], event(rest, "claude", subtype=F.concat(F.lit("claude."), F.coalesce(kind, F.lit("unknown"))), input=text_of(given(r, "$.data.message")), status="PRESERVED"))
    message = kind.isin("user", "assistant")
    return F.when(message & listed, let(blocks, lambda b: F.when(F.size(b) > 0, b).otherwise(F.array(empty)))).when(message, F.array(plain)).otherwise(F.array(single))


def generic(r: Column, harness: Column) -> Event:
    """harness is generic or antigravity."""
    kind = F.coalesce(at(r, "$.type"), at(r, "$.event"), at(r, "$.kind"), F.lit("unknown"))
    role = F.coalesce(at(r, "$.role"), at(r, "$.actor.role"), at(r, "$.message.role"))
    tool, subtype = F.coalesce(at(r, "$.tool_name"), at(r, "$.toolName"), at(r, "$.tool.name"), at(r, "$.name")), F.concat(harness, F.lit(".generic"))
    said = {"subtype": subtype, "input": text_of(given(r, "$.message.content", "$.message", "$.content", "$.text")), "native_id": F.coalesce(at(r, "$.id"), at(r, "$.uuid"))}
    message = (F.coalesce(role, F.lit("")) != "") | kind.isin("user", "assistant", "message")
    call = (F.coalesce(tool, F.lit("")) != "") | kind.contains("tool") | (F.coalesce(at(r, "$.command"), F.lit("")) != "")
    result, exit_code = given(r, "$.output", "$.result"), at(r, "$.exit_code", "double")
    failed = (text_of(given(r, "$.error")) != "") & (F.coalesce(at(r, "$.error"), F.lit("")) != "false") | F.coalesce(exit_code > 0, F.lit(False))
    made = {"artifacts": tool_artifacts(tool, F.coalesce(given(r, "$.input", "$.arguments"), r)), "subtype": subtype, "input": text_of(given(r, "$.input", "$.arguments", "$.command")), "output": text_of(result),
            "call_id": F.coalesce(at(r, "$.call_id"), at(r, "$.callId"), at(r, "$.tool_use_id"), at(r, "$.id")), "tool_name": F.coalesce(tool, F.when(at(r, "$.command").isNotNull(), "shell").otherwise("unknown"))}
    return first_of([
        (message & (F.coalesce(role == "user", F.lit(False)) | (kind == "user")), event("message.user", "user", **said)),
        (message, event("message.agent", "agent", **said)),
        (call & (result.isNotNull() | exit_code.isNotNull()), event("tool.completed", actor("act:tool:", tool, "TOOL"), **made, status=F.when(failed, "FAILED").otherwise("COMPLETED"))),
        (call, event("tool.requested", "agent", **made, status="REQUESTED")),
    ], event("forensic.unknown_record", (F.concat(F.lit("act:harness:"), harness), "SYSTEM"), subtype=F.concat(harness, F.lit("."), kind), status="PRESERVED"))


def harness_of(source: Column, r: Column) -> Column:
    """By the path, else by the record, which should be the first of its source."""
    kind = F.coalesce(at(r, "$.type"), F.lit(""))
    known = F.coalesce(*[F.nullif(at(r, f"$.{k}"), F.lit("")) for k in ("conversationId", "transcriptPath", "artifactDirectory")])
    return (F.when(source.rlike(r"(?i)[/\\]\.?codex[/\\]"), "codex").when(source.rlike(r"(?i)[/\\]\.claude[/\\]"), "claude").when(source.rlike(r"(?i)[/\\](antigravity|\.gemini)[/\\]"), "antigravity")
            .when(kind.isin(*CODEX_TYPES), "codex").when((F.coalesce(at(r, "$.sessionId"), F.lit("")) != "") & kind.isin(*CLAUDE_TYPES), "claude").when(known.isNotNull(), "antigravity").otherwise("generic"))


def session_fields(r: Column, p: Column, harness: Column) -> Column:
    """What the record says of its session, null where the family's record says nothing."""
    ids = F.when(harness == "codex", F.coalesce(at(p, "$.session_id"), at(p, "$.id"))).when(harness == "claude", at(r, "$.sessionId")).otherwise(F.coalesce(at(r, "$.session_id"), at(r, "$.sessionId"), at(r, "$.conversationId")))
    parent = F.when(harness == "codex", F.coalesce(at(p, "$.parent_thread_id"), at(p, "$.forked_from_id"))).when(harness != "claude", F.coalesce(at(r, "$.parent_session_id"), at(r, "$.parentSessionId")))
    said = F.struct(ids.alias("native_id"), parent.alias("parent"), F.coalesce(at(p, "$.cwd"), at(p, "$.workspace")).alias("cwd"), fn.moment(given(p, "$.timestamp", "$.time")).alias("started_at"), at(p, "$.title").alias("title"),
                    F.coalesce(at(p, "$.cli_version"), at(p, "$.version")).alias("version"), F.coalesce(at(p, "$.model"), at(p, "$.message.model")).alias("model"))
    return F.when((harness != "codex") | (at(r, "$.type") == "session_meta"), said)


def records(accounted: DataFrame) -> DataFrame:
    """accounted() lines as records: top-level arrays are taken apart, the harness of a source is that of its path or
    first line, and the session is the one last named in the source, else its file name."""
    parts = F.when(kind_of(F.col("value")).startswith("ARRAY"), items(F.col("value"))).otherwise(F.array("value"))
    guess = accounted.groupBy("source").agg(F.max(F.when(F.col("ordinal") == 1, harness_of(F.col("source"), F.col("value")))).alias("harness"))
    rows = accounted.join(guess, "source").select("source", "ordinal", "harness", "status", "line", F.posexplode_outer(parts).alias("part", "record"))
    own, codex_row = F.col("record"), F.col("harness") == "codex"
    rows = rows.withColumn("payload", F.when(codex_row, given(own, "$.payload"))).withColumn("item", given(F.col("payload"), "$.item")).withColumn("base", F.when(codex_row, F.col("payload")).otherwise(own))
    rows = rows.withColumn("said", F.when(own.isNotNull(), session_fields(own, F.col("base"), F.col("harness")))).drop("base")
    order = Window.partitionBy("source").orderBy("ordinal", "part")
    name = F.regexp_extract("source", r"([^/\\]+)$", 1)
    own = F.when(F.col("harness") == "codex", F.last("said.native_id", ignorenulls=True).over(order)).otherwise(F.col("said.native_id"))
    return rows.withColumn("session", F.coalesce(own, name))


def normalized(accounted: DataFrame, families: tuple[str, ...] = ("codex", "claude", "generic")) -> DataFrame:
    """One row per event: ids, session, time, FIELDS, artifacts and session edges. Lines that are no JSON stay as
    unparsed records. Empty input gives no rows. Naming the families that occur makes the plan shorter; records of
    others become generic ones."""
    r, p, harness = F.col("record"), F.col("payload"), F.col("harness")
    made = F.when(F.col("status") == "UNPARSED", F.array(event("forensic.unparsed_record", (F.concat(F.lit("act:harness:"), harness), "SYSTEM"), status="PRESERVED")))
    if "codex" in families:
        made = made.when(harness == "codex", F.array(codex(r, p, F.col("item"), F.col("session"))))
    if "claude" in families:
        made = made.when(harness == "claude", claude(r))
    made = made.otherwise(F.array(generic(r, harness)))
    when = F.coalesce(given(r, "$.timestamp"), given(p, "$.timestamp", "$.occurred_at_ms", "$.started_at", "$.completed_at"), given(r, "$.occurred_at_ms", "$.started_at", "$.completed_at"))
    rows = records(accounted).withColumn("observed_at", fn.moment(when)).withColumn("time_precision", F.when(F.col("observed_at").isNull(), "ORDER_ONLY").otherwise(fn.precision(F.col("observed_at"))))
    rows = rows.select("source", "ordinal", "harness", F.concat_ws(":", F.lit("ses"), harness, "session").alias("session_id"), "observed_at", "time_precision", "part", F.posexplode(made).alias("at", "e"))
    rows = rows.withColumn("subordinal", F.coalesce(F.col("part"), F.lit(0)) * 1000 + F.col("at"))
    return rows.select(fn.stable_id("evt-", 24, F.col("source"), F.col("ordinal"), F.col("subordinal"), F.col("e.kind")).alias("event_id"), "source", "ordinal", "subordinal", "harness", "session_id", "observed_at", "time_precision", "e.*")


def sessions(accounted: DataFrame) -> DataFrame:
    """One row per session: the last value that is not null of each field, the first for started_at. Every source
    names a session of its own, by its file name if no record does."""
    order = F.struct("source", "ordinal", "part")
    last = [F.max_by(f"said.{c}", F.when(F.col(f"said.{c}").isNotNull(), order)).alias(c) for c in ("parent", "cwd", "title", "version", "model")]
    rows = records(accounted).groupBy(F.concat_ws(":", F.lit("ses"), "harness", "session").alias("session_id"), "harness", F.col("session").alias("native_id"))
    return rows.agg(*last, F.min_by("said.started_at", F.when(F.col("said.started_at").isNotNull(), order)).alias("started_at"))


def session_edges(events: DataFrame) -> DataFrame:
    """Distinct (parent, child, type) of normalized() events."""
    return events.select(F.inline("edges")).distinct()


def artifacts(events: DataFrame) -> DataFrame:
    """One row per file an event touched."""
    return events.select("event_id", "session_id", "observed_at", F.inline("artifacts"))
