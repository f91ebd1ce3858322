import json
import re

from pyspark.sql import functions as F

from caselake.functions import text as fn
from caselake.operators import graph, retrieval
from caselake.sources import jsonl, transcripts

THREAD = "0123abcd-0000-4000-8000-00000000beef"


def response(**p):
    return {"timestamp": "2025-03-01T10:00:00.250Z", "type": "response_item", "payload": p}


def message(**p):
    return {"type": "event_msg", "payload": p}


def item(**i):
    return message(type="item_completed", thread_id="t-1", turn_id="u-1", item=i)


CODEX = [
    ({"type": "session_meta", "payload": {"id": "s-1", "cwd": "/w", "forked_from_id": "s-0", "timestamp": 1700000000}}, "session.meta", "OBSERVED"),
    (response(type="message", role="developer", content=[{"type": "input_text", "text": "rules"}]), "message.instruction", None),
    (response(type="message", role="user", content=[{"type": "input_text", "text": "fix it"}, "now", {"type": "image"}]), "message.user", None),
    (response(type="function_call", name="write_file", namespace="fs", arguments='{"path": "a.py"}', call_id="c1"), "tool.requested", "REQUESTED"),
    (response(type="function_call_output", call_id="c1", output='{"exit_code": 2, "output": "no"}'), "tool.completed", "FAILED"),
    (response(type="function_call_output", call_id="c2", output="all good"), "tool.completed", "COMPLETED"),
    (response(type="function_call_output", call_id="c3", output="it exited with exit code 1 then"), "tool.completed", "FAILED"),
    (response(type="reasoning", summary=[]), "reasoning.summary", "UNAVAILABLE"),
    (response(type="ghost"), "forensic.unknown_record", "PRESERVED"),
    (message(type="patch_apply_end", success=True, changes={"b.py": {"type": "add"}, "c.py": None}), "filesystem.patch", "COMPLETED"),
    (message(type="sub_agent_activity", agent_thread_id="s-9", kind="started"), "external.subagent", "started"),
    (message(type="mcp_tool_call_end", invocation={"server": "srv", "tool": "look", "arguments": {"q": 1}}, result={"Err": "x"}), "mcp.completed", "FAILED"),
    (message(type="task_complete", last_agent_message="done"), "session.task_complete", "COMPLETED"),
    (message(type="token_count"), "telemetry.token_count", "OBSERVED"),
    (item(type="CommandExecution", command=["ls", "-l"], stdout="a", stderr="b", exit_code=0), "tool.observed", "COMPLETED"),
    (item(type="McpToolCall", tool="create_thread", status="completed", result={"content": [{"type": "text", "text": json.dumps({"threadId": THREAD})}]}), "mcp.observed", "COMPLETED"),
    (item(type="FileChange", changes={"d.py": {"type": "update"}}), "filesystem.patch", "COMPLETED"),
    (item(type="Mystery"), "forensic.unknown_record", "PRESERVED"),
    ({"type": "compacted", "payload": {"replacement_history": "short"}}, "session.compacted", "OBSERVED"),
    ({"type": "realtime_item", "payload": {"type": "transcript_segment", "role": "user", "text": "hi"}}, "realtime.transcript", None),
]


def read(spark, tmp_path, name, lines):
    (tmp_path / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return jsonl.accounted(jsonl.lines(spark, str(tmp_path / name)))


def test_codex(spark, tmp_path):
    rows = read(spark, tmp_path, "a.jsonl", [x for x, _, _ in CODEX])
    found = transcripts.normalized(rows, ("codex",)).orderBy("ordinal", "subordinal").collect()
    assert [(r.kind, r.status) for r in found] == [(k, s) for _, k, s in CODEX]
    assert {r.harness for r in found} == {"codex"} and {r.session_id for r in found} == {"ses:codex:s-1"}
    assert found[2].input == "fix it\nnow" and found[3].tool_name == "fs.write_file" and found[3].time_precision == "MILLISECOND"
    assert [tuple(a) for a in found[3].artifacts] == [("a.py", "CREATE_OR_REPLACE")] and {tuple(a) for a in found[9].artifacts} == {("b.py", "ADD"), ("c.py", "UPDATE")}
    assert found[14].input == "ls -l" and found[14].output == "a\nb" and found[4].output == '{"exit_code": 2, "output": "no"}'
    edges = {tuple(e) for r in found for e in r.edges}
    assert edges == {("s-0", "s-1", "FORKED"), ("s-1", "s-9", "SPAWNED"), ("t-1", THREAD, "DELEGATED_TASK")}
    session = transcripts.sessions(rows).collect()
    assert [(s.native_id, s.parent, s.cwd) for s in session] == [("s-1", "s-0", "/w")] and session[0].started_at.year == 2023


def test_claude(spark, tmp_path):
    lines = [
        {"type": "user", "sessionId": "k", "uuid": "1", "message": {"role": "user", "content": "please"}},
        {"type": "assistant", "sessionId": "k", "message": {"role": "assistant", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "t", "name": "Edit", "input": {"file_path": "x"}}, {"type": "other"}, 3]}},
        {"type": "user", "sessionId": "k", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": "bad"}], "is_error": True}]}},
        {"type": "assistant", "sessionId": "k", "message": {"content": []}},
        {"type": "file-history-snapshot", "snapshot": {"trackedFileBackups": {"y": {}, "x": {}}}},
        {"type": "summary", "summary": "sum"},
        {"type": "progress", "data": {"message": "m"}},
        {"type": "system", "subtype": "compact_boundary", "content": "c"},
        {"type": "what"},
    ]
    found = transcripts.normalized(read(spark, tmp_path, "b.jsonl", lines), ("claude",)).orderBy("ordinal", "subordinal").collect()
    assert [(r.kind, r.input or r.output) for r in found] == [
        ("message.user", "please"), ("message.agent", "ok"), ("tool.requested", '{"file_path":"x"}'), ("tool.completed", "bad"), ("forensic.unknown_record", ""), ("filesystem.snapshot", ""),
        ("session.compacted", "sum"), ("external.hook", "m"), ("session.compacted", "c"), ("forensic.unknown_record", "")]
    assert [r.subordinal for r in found[:4]] == [0, 0, 1, 0] and found[3].status == "FAILED" and len(found[5].artifacts) == 2
    assert found[0].session_id == "ses:claude:k" and found[5].session_id == "ses:claude:b.jsonl"


def test_generic_arrays_and_broken_lines(spark, tmp_path):
    lines = [
        {"session_id": "g", "role": "user", "content": "hello"},
        {"session_id": "g", "type": "tool_call", "tool_name": "run", "call_id": "1", "input": {"b": 1}},
        {"session_id": "g", "type": "tool_result", "tool_name": "run", "call_id": "1", "output": "x", "exit_code": 3},
        "{broken",
        [{"role": "assistant", "text": ["a", "b"]}, {"odd": 1}],
        "5",
    ]
    rows = read(spark, tmp_path, "c.jsonl", lines)
    found = transcripts.normalized(rows, ("generic",)).orderBy("ordinal", "subordinal").collect()
    assert [(r.kind, r.status, r.subordinal) for r in found] == [
        ("message.user", None, 0), ("tool.requested", "REQUESTED", 0), ("tool.completed", "FAILED", 0), ("forensic.unparsed_record", "PRESERVED", 0), ("message.agent", None, 0),
        ("forensic.unknown_record", "PRESERVED", 1000), ("forensic.unknown_record", "PRESERVED", 0)]
    assert found[4].input == "a\nb" and found[1].input == '{"b":1}' and len({r.event_id for r in found}) == len(found)
    assert transcripts.normalized(rows.limit(0), ("generic",)).count() == 0


def test_redaction(spark):
    import hashlib

    key = "ghp_" + "a1" * 12
    texts = [f"use {key} and {key}.", 'password = "hunter2hunter2"', "token: none", "secret: SomeTypeName", "api_key=${FROM_ENV_VAR}", None, "", "AKIA" + "Z" * 16 + " end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {r.id: r for r in fn.redacted(rows, "text").collect()}
    h = lambda s, n: hashlib.sha256(s.encode()).hexdigest()[:n]
    assert found[0].text == f"use [REDACTED:github-token:{h(key, 8)}] and [REDACTED:github-token:{h(key, 8)}]." and [tuple(f) for f in found[0].findings] == [("github-token", h(key, 12))] * 2
    assert re.fullmatch(r'\[REDACTED:credential-assignment:[0-9a-f]{8}\]"', found[1].text)
    assert [found[k].text for k in (2, 3, 4, 5, 6)] == texts[2:7] and not any(found[k].findings for k in (2, 3, 4, 6))
    assert found[7].text == f"[REDACTED:aws-access-key:{h('AKIA' + 'Z' * 16, 8)}] end"


def test_word_chunks(spark):
    long = "word " * 1000
    rows = spark.createDataFrame([(1, long), (2, "short"), (3, None), (4, ""), (5, "x" * 4000)], "id long, text string")
    found = retrieval.word_chunks(rows, "id", "text").orderBy("id", "chunk").collect()
    assert {r.id for r in found} == {1, 2, 5} and all(len(r.content) <= 1600 and r.content == r.content.strip() for r in found)
    parts = [r for r in found if r.id == 1]
    assert all(b.begin < a.begin + 1600 and a.content.endswith("word") for a, b in zip(parts, parts[1:], strict=False))
    assert [r.begin for r in found if r.id == 5] == [0, 1400, 2800] and [r.content for r in found if r.id == 2] == ["short"]


def test_seeded_expansion(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("e", "e"), ("c", "f"), ("f", "g"), ("g", "h")], "src string, dst string")
    seeds = spark.createDataFrame([("a", 1), ("d", 2)], "node string, rank int")
    found = {r.node: (r.seed_rank, r.depth) for r in graph.seeded(edges, seeds).collect()}
    assert found == {"a": (1, 0), "d": (2, 0), "b": (1, 1), "c": (2, 1), "f": (2, 2), "g": (2, 3), "h": (2, 4)}
    cut = graph.seeded(edges, seeds, limit=3).collect()
    assert sorted(r.node for r in cut) == ["a", "b", "d"] and all(r.truncated for r in cut) and abs(cut[0].contribution - 1 / 61) < 1e-12
    assert graph.seeded(edges, seeds.where(F.lit(False))).count() == 0
