"""Ledgers, search, checks, embeddings, acquisition and sinks on hand-written cases."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from caselake.functions import reading
from caselake.operators import checks, graph, ledger, search, semantic
from caselake.sinks import case
from caselake.sources import acquire

EVENT = "event_id string, session_id string, observed_at timestamp, kind string, call_id string, tool string, command string, status string, exit_code int, text string"


def order():
    return F.struct("observed_at", "event_id")


def events(spark, rows):
    return spark.createDataFrame([(f"e{i}", "s", datetime(2024, 1, 1, 0, i), *r) for i, r in enumerate(rows)], EVENT)


def values(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_functions(spark):
    lit = F.lit
    got = values(spark, *[reading.size_text(lit(n)).alias(str(n)) for n in (0, 1023, 1024, 1536, 10240, 5 << 20, 3 << 50)])
    assert list(got) == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "10 KiB", "5.0 MiB", "3072 TiB"]
    assert values(spark, reading.duration_text(lit(3_723_999)))[0] == "1h 2m 3s"
    assert values(spark, reading.stems(lit("Deployments failed; the builds worked on migrations, s")))[0] == ["deploy", "fail", "build", "work", "migr"]
    assert values(spark, reading.related(lit("Deployment done"), lit("shell deploy --all")), reading.related(lit("x"), lit("x")))[:] == (True, False)
    asked = ["", "  hi  ", "<environment_context> x", "noise\n## My request:\n do it", "<realtime_delegation>a<input> go </input></realtime_delegation>", "<a><b>x</b></a>", "<a><b>x</b></a> ok."]
    assert list(values(spark, *[reading.substantive(lit(x)) for x in asked])) == [None, "hi", None, "do it", "go", None, "<a><b>x</b></a> ok."]
    commands = ["cd a && npm run test", "npm install", "python -m pytest -q", "echo pytest", "ls; cargo  test --all", None, "tsc --noEmit"]
    assert list(values(spark, *[reading.is_validation(lit(x).cast("string")) for x in commands])) == [True, False, True, False, True, False, True]
    assert values(spark, reading.validation_status(lit("COMPLETED"), lit(2)), reading.validation_status(lit("failed"), lit(None).cast("int")), reading.validation_status(lit("x"), lit(0)))[:] == ("OBSERVED_FAIL", "OBSERVED_FAIL", "OBSERVED_PASS")
    assert values(spark, reading.extract_command(lit('{"cmd": "ls"}')), reading.extract_command(lit("a cmd: \"x\\\"y\" command: 'b\\nc'")), reading.extract_command(lit("none")))[:] == ("ls", 'x"y\n--- nested command ---\nb\nc', None)
    assert values(spark, reading.artifact_kind(lit("/a/b.MD")), reading.artifact_kind(lit("x.sql")), reading.artifact_kind(lit(".env")), reading.stored_suffix(lit("a.verylongsuffix")))[:] == ("DOCUMENT", "SCHEMA", "FILE", "txt")
    assert values(spark, reading.logical_path(lit("/w/a/b.py"), lit("/w/")), reading.logical_path(lit("C:\\w\\a"), lit("C:\\w")), reading.logical_path(lit("/wide/a"), lit("/w")))[:] == ("a/b.py", "a", "/wide/a")
    assert values(spark, reading.semantic_extract(lit("a\nb\n\nc\nd\ne"), lit("OK"), lit(None).cast("int")))[0] == "status=OK\na\nb\nc\nd\nb\nc\nd\ne"
    assert values(spark, reading.semantic_extract(lit("one\nError: x\ntwo"), lit("FAILED"), lit(1)))[0] == "status=FAILED\nexit_code=1\nError: x"
    assert values(spark, reading.decisions(lit("x\nDecision: use A \nDecisión : B")))[0] == ["use A", "B"]
    assert values(spark, reading.completions(lit("Done: the parser works\nall completed")))[0] == ["the parser works"]
    uri = "case://evidence/sha256/" + "a" * 64 + "/record/7#bytes=3:9"
    assert values(spark, reading.address(lit(uri)).alias("a"))[0].asDict() == {"sha256": "a" * 64, "ordinal": 7, "offset": 3, "length": 9}
    assert values(spark, reading.address(lit("case://evidence/sha256/x/record/7")))[0] is None
    assert values(spark, reading.stable_json(b=lit(1), a=lit(None).cast("string")), reading.escaped(lit("a`b\n c")), reading.label(lit("evt-0123456789abc")), reading.quoted(lit(" a\n\nb ")), reading.terms(lit("Étion's L'Œuvre, naïve")))[:] == ('{"a":null,"b":1}', "aˋb c", "EV-0123456789", "“a b”", ["etion", "s", "l", "œuvre", "naive"])
    assert values(spark, reading.search_text(lit("a  b\r\n\n\n\nc ")), reading.ratio(lit(1), lit(0)))[:] == ("a b\n\nc", 1.0)


def test_tools_tasks_validations_and_contradictions(spark):
    rows = events(spark, [
        ("message.user", None, None, None, None, None, "please fix the parser"), ("tool.requested", "c1", "shell", "pytest  parser", "REQUESTED", None, None), ("tool.completed", "c1", None, None, "FAILED", 1, None),
        ("message.user", None, None, None, None, None, "<environment_context>"), ("tool.completed", "c2", "shell", "ls", "COMPLETED", 0, None), ("tool.requested", "c2", "shell", "other", "REQUESTED", None, None),
        ("tool.requested", "c3", "shell", "make parser", "REQUESTED", None, None), ("tool.observed", None, "shell", "Pytest parser", "COMPLETED", 0, None), ("message.agent", None, None, None, None, None, "Done: parser is fixed"),
    ])
    tools = ledger.tools(rows, order())
    got = {r.call_id: (r.call_event, r.result_event, r.command, r.status, r.exit_code) for r in tools.collect()}
    assert got == {"c1": ("e1", "e2", "pytest  parser", "FAILED", 1), "c2": (None, "e4", "ls", "REQUESTED", 0), "c3": ("e6", None, "make parser", "INCOMPLETE", None)}
    assert [(r.src, r.dst) for r in ledger.result_edges(tools).collect()] == [("e1", "e2")]
    assert [(r.requested_event, r.last_event, r.state) for r in ledger.tasks(rows, order()).collect()] == [("e0", "e1", "ATTEMPTED")]
    seen = rows.where("kind = 'tool.observed'")
    assert [(r.event_id, r.origin, r.status) for r in ledger.validations(tools, seen).collect()] == [("e7", "historical-observation", "OBSERVED_PASS")]
    assert [(r.event_id, r.status) for r in ledger.validations(tools, seen.limit(0)).collect()] == [("e2", "OBSERVED_FAIL")]
    assert [(r.event_id, r.matched_call) for r in ledger.observed_calls(rows.withColumn("command", F.lower(reading.compact(F.col("command")))), order()).collect()] == [("e7", "c1")]
    claims = ledger.completion_claims(rows)
    assert [r.report for r in claims.collect()] == ["parser is fixed"]
    at = rows.select("event_id", F.unix_seconds("observed_at").alias("at"))
    reports = claims.join(at, "event_id").select("claim_id", "session_id", "at", F.col("report").alias("text"))
    run = tools.withColumn("event_id", F.coalesce("result_event", "call_event")).join(at, "event_id").select("call_id", "session_id", "at", F.concat_ws(" ", "tool", "command").alias("text"), "status", "fingerprint")
    assert sorted(r.call_id for r in ledger.contradictions(reports, run).collect()) == ["c1", "c3"]
    fixed = run.union(spark.createDataFrame([("c9", "s")], "c string, s string").crossJoin(run.where("call_id = 'c1'").select((F.col("at") + 1).alias("at"), "text", F.lit("COMPLETED"), "fingerprint")))
    assert [r.call_id for r in ledger.contradictions(reports, fixed).collect()] == ["c3"]
    pairs = spark.createDataFrame([("e2", "e8"), ("e2", "gone")], "failure_event string, report_event string")
    assert [tuple(r) for r in ledger.contradiction_edges(pairs, rows).collect()] == [("e2", "e8", "CONTRADICTS")]
    assert ledger.decision_records(rows).count() == 0 and ledger.last_rows(rows, ["session_id"], order(), 2).count() == 2


def test_artifacts_and_state(spark):
    t = lambda i: datetime(2024, 1, 1, 0, i)
    rows = [("/w", "/w/a.md", "e1", "CREATE", "h1", "LIVE_UNVERIFIED", t(1)), ("/w", "/w/a.md", "e2", "UPDATE", "h2", "LIVE_UNVERIFIED", t(2)), ("/w", "/w/a.md", "e2", "UPDATE", None, "FAILED", t(3)), (None, "b.json", "e3", "add", None, "LIVE_UNVERIFIED", t(1))]
    touches = spark.createDataFrame(rows, "root string, path string, event_id string, operation string, sha256 string, status string, observed_at timestamp")
    art = ledger.artifacts(touches, order())
    assert {r.logical_path: (r.kind, r.current_status, r.current_sha256) for r in art.collect()} == {"a.md": ("DOCUMENT", "FAILED", "h2"), "b.json": ("CONFIGURATION", "LIVE_UNVERIFIED", None)}
    edges = ledger.revision_edges(ledger.revisions(touches, order()))
    assert sorted(r.type for r in edges.collect()) == ["MODIFIED", "MODIFIED", "MODIFIED", "PRODUCED", "SUPERSEDES"]
    seen = art.select("artifact_id", F.lit("/new").alias("path"), F.when(F.col("logical_path") == "a.md", "h2").alias("sha256"))
    now = ledger.by_priority(ledger.current_state(art, seen), [])
    assert [(r.logical_path, r.current_status, r.current_path) for r in now.orderBy("rank").collect()] == [("b.json", "MISSING", "/new"), ("a.md", "LIVE_VERIFIED", "/new")]


def test_search(spark):
    t = lambda i: datetime(2024, 1, 1, 0, i)
    rows = [("e1", t(3), "Fix the Pärser now", "call", "s1", "USER", None, "message.user", None), ("e2", t(1), "the parser", "fix it", "s1", "AGENT", "lead", "message.agent", "OK"), ("e3", None, "parser the", "fix", "s2", "USER", None, "message.user", None)]
    ev = spark.createDataFrame(rows, "event_id string, observed_at timestamp, input string, output string, session_id string, actor_kind string, actor_role string, kind string, status string")
    index = search.term_index(ev, ["input", "output"])
    find = lambda q: sorted(r.event_id for r in search.matches(index, q).collect())
    assert find("parser fix") == ["e1", "e2", "e3"] and find("the-parser") == ["e1", "e2"] and find("parser-fix") == [] and find("...") == []
    ranked = search.in_time_order(ev, search.matches(index, "fix"), ["observed_at", "event_id"], 10)
    assert [(r.event_id, r.rank) for r in ranked.orderBy("rank").collect()] == [("e3", 1), ("e2", 2), ("e1", 3)]
    ids = lambda df: sorted(r.event_id for r in df.collect())
    assert ids(search.filtered(ev, actor="lead")) == ["e2"] and ids(search.filtered(ev, actor="lead", by_role=False)) == []
    assert ids(search.filtered(ev, since="2024-01-01T00:02:00")) == ["e1"] and ids(search.filtered(ev, until="2024-01-01T00:01:00")) == ["e2"]
    refs = spark.createDataFrame([("r1", "e1", "a", 1, "x", "GONE", "u1"), ("r2", "e2", "a", 2, None, "AVAILABLE", "u2")], "ref_id string, event_id string, source string, ordinal int, sha256 string, availability string, uri string")
    assert ids(search.filtered(ev, kind="message.agent", session="s1", status="OK", refs=refs)) == ["e2"]
    with pytest.raises(ValueError):
        search.filtered(ev, since="soon")
    sessions = spark.createDataFrame([("s1", "n1"), ("s2", "s1")], "session_id string, native_id string")
    assert [search.session_filter(sessions, x) for x in ("s1", "n1", "zz", None)] == ["s1", "s1", "UNRESOLVED_SESSION:zz", None]
    assert search.dispatch("hybrid", lexical=lambda: 1, fused=lambda: 2) == ("UNAVAILABLE", None) and search.dispatch("lexical", lexical=lambda: 1) == ("lexical", 1)
    records = spark.createDataFrame([("a", 1, "line one"), ("a", 2, "line two")], "source string, ordinal int, line string")
    good = refs.withColumn("sha256", F.when(F.col("ordinal") == 2, F.sha2(F.lit("line two"), 256)).otherwise("x"))
    assert search.evidence_failures(ev, good, records).first()[:] == (3, 2)
    assert search.read_evidence(good, records, "u2").first()[:2] == (True, "line two") and search.read_evidence(good, records, "u1").first()[:2] == (False, None)
    assert search.read_evidence(good, records, "other").count() == 0
    states = [values(spark, search.assessed(F.lit(a), F.lit(b), F.lit(c)))[0] for a, b, c in ((2, 0, 1), (2, 1, 0), (0, 0, 1), (0, 0, 0))]
    assert states == ["VERIFIED_PRESENT", "INCONCLUSIVE_COVERAGE", "INCONCLUSIVE_COVERAGE", "NOT_OBSERVED_IN_CAPTURED_EVIDENCE"]
    a = search.receipt(ranked.join(ledger.addresses(refs), "event_id", "left"), "fix", "h", "lexical").first()
    assert a.results == 3 and len(a.result_set_sha256) == 64
    wanted = spark.createDataFrame([("q", "m1"), ("q", "m2")], "query string, marker string")
    assert search.recall(spark.createDataFrame([("q", "m1", 2), ("q", "m2", 9)], "query string, marker string, rank int"), wanted, 5).first()[:] == (0.5, 2.0)
    edges = spark.createDataFrame([("e1", "x", "T")], "src string, dst string, type string")
    assert ledger.show(ev, refs, edges, "e1").first().uris == ["u1"] and ledger.first_address(refs).first()[:] == ("e2", "u2")


def test_checks_fail_closed(spark):
    records = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "source string, ordinal int, line string").withColumn("sha256", F.sha2("line", 256)).withColumn("byte_length", F.octet_length("line"))
    ok = lambda df: df.first().ok
    assert ok(checks.records(records, records)) and not ok(checks.records(records.where("ordinal = 1"), records)) and not ok(checks.records(records.withColumn("line", F.lit("z")), records))
    refs = records.select("source", "ordinal", "sha256", F.concat(F.lit("r"), "ordinal").alias("ref_id"))
    assert ok(checks.references(refs, records)) and not ok(checks.references(refs.withColumn("sha256", F.lit(None).cast("string")), records)) and not ok(checks.references(refs.withColumn("ordinal", F.lit(9)), records))
    assert ok(checks.coverage(records, refs)) and not ok(checks.coverage(records, refs.limit(1)))
    edges = spark.createDataFrame([("a", "b", "r1"), ("b", "c", "r9")], "src string, dst string, ref_id string")
    nodes = checks.all_nodes(spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("b",)], "id string"))
    assert not ok(checks.edge_ends(edges, nodes, "e")) and ok(checks.edge_ends(edges.limit(1), nodes, "e")) and not ok(checks.edge_evidence(edges, refs))
    blob = case.blobs(spark.createDataFrame([("t",), ("t",), ("x" * 20_000,), (None,)], "text string"))
    assert sorted((r.byte_length, r.storage) for r in blob.collect()) == [(1, "INLINE"), (20_000, "EXTERNAL")] and ok(checks.blobs(blob)) and not ok(checks.blobs(blob.withColumn("byte_length", F.lit(3))))
    counted = ledger.count_rows(events=records, tools=edges)
    assert ok(checks.metrics(counted, counted)) and not ok(checks.metrics(counted.limit(1), counted))
    src = spark.createDataFrame([("u2", "h", "n", "s", 1), ("u1", "h", None, "s", 2)], "uri string, harness string, native_id string, sha256 string, byte_length long")
    one = checks.snapshot(src, schema="1").first()
    assert one == checks.snapshot(src.orderBy("uri"), schema="1").first() and one.case_hash != checks.snapshot(src, schema="2").first().case_hash
    assert ok(checks.equal(checks.snapshot(src), "source_snapshot", one.source_snapshot, "case")) and not ok(checks.equal(checks.snapshot(src), "source_snapshot", None, "case"))
    assert not ok(checks.complete(spark.createDataFrame([("RUNNING",)], "status string"))) and not ok(checks.complete(spark.createDataFrame([], "status string")))
    chunks, vectors = spark.createDataFrame([("c1", "h1")], "chunk_id string, content_sha256 string"), spark.createDataFrame([("h1", [1.0, 0.0]), ("h2", [float("nan"), 0.0])], "content_sha256 string, vector array<double>")
    found = checks.projection(chunks, vectors, 2)
    assert checks.passed(found).first()[:] == (False, ["projection.orphans", "projection.vectors"]) and checks.passed(checks.projection(chunks, vectors.limit(1), 2)).first().passed
    assert checks.receipt({"sources": 1})["readiness"] == "READY" and checks.receipt({"unparsedRecords": 2})["anomalies"] == ["2 unparsed record(s)"]


def test_semantic_index(spark):
    ev = spark.createDataFrame([("e1", True, "the parser is fixed"), ("e2", True, "the parser is fixed"), ("e3", True, "  "), ("e4", False, "hidden"), ("e5", True, "no address"), ("e6", True, "weather report " * 300)], "event_id string, canonical boolean, text string")
    refs = spark.createDataFrame([(f"r{i}", f"e{i}", "u", "AVAILABLE") for i in (1, 2, 3, 4, 6)], "ref_id string, event_id string, uri string, availability string")
    chunks = semantic.chunks(ev, refs)
    provider = semantic.HashingProvider(32)
    vectors = semantic.embedded(chunks, provider)
    got = {r.content_sha256: (r.occurrences, len(r.vector)) for r in vectors.collect()}
    assert set(r.event_id for r in chunks.collect()) == {"e1", "e2", "e6"} and sorted(got.values())[-1] == (2, 32)
    ids = vectors.withColumn("id", F.monotonically_increasing_id())
    q = spark.createDataFrame([(7, provider.embed(["parser fixed"])[0])], "id long, vector array<double>")
    hits = semantic.nearest(ids, q, 3).join(ids.drop("vector"), "id")
    assert {r.event_id for r in semantic.best_per_event(hits.where("rank = 1"), chunks).collect()} == {"e1", "e2"}
    for wrong in ([[1.0]], [[float("inf")] * 32]):
        with pytest.raises(ValueError):
            semantic.checked_vectors(wrong, 1, 32)
    with pytest.raises(ValueError):
        semantic.checked_identity(provider, provider.identity | {"model": "other"})
    assert list(semantic.batches(["a" * 5, "b", "c" * 9], 2, 6)) == [["a" * 5, "b"], ["c" * 9]] and semantic.coverage_gaps(chunks.limit(0))
    done = spark.createDataFrame([("p1", "COMPLETE", 1), ("p2", "BUILDING", 2)], "projection_id string, status string, created_at int")
    assert semantic.latest(done).first().projection_id == "p1"


def test_graph_paths_and_filters(spark):
    edges = spark.createDataFrame([("a", "b", "X"), ("b", "c", "X"), ("a", "c", "Y"), ("c", "d", "X"), ("e", "d", "X")], "src string, dst string, type string")
    steps = lambda *a, **k: [(r.src, r.dst, r.type, r.reverse) for r in graph.path(edges, *a, **k).orderBy("step").collect()]
    assert steps("a", "d") == [("a", "c", "Y", False), ("c", "d", "X", False)] and steps("a", "d", types="x") == [("a", "b", "X", False), ("b", "c", "X", False), ("c", "d", "X", False)]
    assert steps("a", "e") == [] and steps("a", "e", direction="both")[-1] == ("d", "e", "X", True) and steps("a", "a") == [] and steps("a", "d", hops=1) == []
    near = graph.neighbors(edges, "a", 2, "out", limit=2)
    assert [(r.node, r.truncated) for r in near.orderBy("depth", "node").collect()] == [("a", True), ("b", True)]
    assert graph.edges_among(edges, graph.neighbors(edges, "a", 1, "out")).count() == 3
    assert graph.described("c", first=spark.createDataFrame([("x",)], "id string"), second=spark.createDataFrame([("c", 1)], "id string, n int")).first()[:] == ("second", '{"id":"c","n":1}')
    assert graph.union(edges.drop("type")).first().type is None


def test_acquire_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name in ("a.jsonl", "deep/b.jsonl.gz", "c.txt"):
        (tmp_path / "in" / name).write_text("{}\n")
    (tmp_path / "in" / "link.jsonl").symlink_to(tmp_path / "in" / "c.txt")
    assert [r.name for r in acquire.files(spark, str(tmp_path / "in")).collect() if r.name != "link.jsonl"] == ["a.jsonl", "b.jsonl.gz"]
    for bad in ("link.jsonl", "../x"):
        with pytest.raises(ValueError):
            acquire.below(str(tmp_path / "in"), bad)
    assert acquire.variants("x.jsonl.gz") == ["x.jsonl.gz", "x.jsonl", "x.jsonl.zst"]
    lines = spark.createDataFrame([("a", 0, 10), ("a", 11, 70 << 20), ("b", 0, 9000)], "source string, byte_offset long, byte_length long")
    sizes = spark.createDataFrame([("a", 1 << 30), ("b", 10)], "source string, size long")
    assert {r.source: r.reason for r in acquire.guarded(lines, sizes).collect()} == {"a": "record too long", "b": "compression ratio too high"}
    assert acquire.frozen(lines.where("source = 'a'"), 11).count() == 1
    sessions = spark.createDataFrame([("ses:x:abc", "abc"), ("ses:x:abd", "abd")], "session_id string, native_id string")
    assert acquire.resolved(sessions, "abc").count() == 1 and acquire.resolved(sessions, "ses:x:abd").count() == 1 and acquire.resolved(sessions, "q").count() == 0
    with pytest.raises(ValueError):
        acquire.resolved(sessions, "ab")
    edges = spark.createDataFrame([("p", "c1", "SPAWNED"), ("c1", "c2", "SPAWNED"), ("q", "p", "SPAWNED")], "src string, dst string, type string")
    assert sorted(r.node for r in acquire.with_children(edges, "p").collect()) == ["c1", "c2", "p"]
    threads = spark.createDataFrame([("t1", "/p", 1000)], "id string, rollout_path string, updated_at_ms long")
    assert acquire.state_sources(threads, spark.createDataFrame([("t1", "t2", "open")], "parent_thread_id string, child_thread_id string, status string"))[1].first()[:] == ("t1", "t2", "SPAWNED", "open")
    with pytest.raises(ValueError):
        acquire.appended(sessions, sessions.limit(1), ["session_id"])
    path = str(tmp_path / "case")
    case.write_case(spark, path, {"session": sessions}, {"schema": 1})
    assert case.read_manifest(spark, path) == {"schema": 1, "status": "COMPLETE"} and case.read_table(spark, path, "session").count() == 2
    with pytest.raises(FileExistsError):
        case.write_case(spark, path, {"session": sessions}, {})
    case.ndjson(sessions.orderBy("session_id").coalesce(1), str(tmp_path / "nd"))
    assert json.loads(spark.read.text(str(tmp_path / "nd")).first().value) == {"session_id": "ses:x:abc", "native_id": "abc"}
    case.canonical_lines(spark.createDataFrame([("a", 2, "y"), ("a", 1, "x")], "source string, ordinal int, line string"), str(tmp_path / "src"))
    ev = spark.createDataFrame([("evt-0123456789ab", "s", 1, "message.user", "hello `x`")], "event_id string, session_id string, ordinal int, kind string, text string")
    refs = spark.createDataFrame([("r1", "evt-0123456789ab", "u1")], "ref_id string, event_id string, uri string")
    assert case.timeline(ev, refs).first().value == "- **EV-0123456789** `message.user` “hello `x`” — u1"
    assert "READY" in case.receipt_text(checks.receipt({"sources": 1}), {"events": 1})
    log = acquire.run_log("r", spark.createDataFrame([(1,)], "started_at int"), ledger.count_rows(a=sessions)).first()
    assert (log.status, log.counts) == ("COMPLETE", {"a": 2})
