"""Queries of the ledgers, searches and checks over a case made of the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselake.functions import reading
from caselake.operators import checks, graph, ledger, retrieval, search, semantic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order() -> Column:
    return F.struct("observed_at", "event_id")

_ROOT = "/w/"


def case_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a case: clicks request tools, purchases and errors are their results, views are observed on their own,
    sign-ups are user messages."""
    e = t(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("ts", F.col("ts").cast("timestamp"))
    kind, k = F.col("event_type"), F.col("k").cast("string")
    pick = lambda *x: F.element_at(F.array(*x), (F.col("k") % 4 + 1).cast("int"))
    tool = kind.isin("click", "purchase", "error")
    return e.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("ts").alias("observed_at"),
        F.when(kind == "click", "tool.requested").when(kind.isin("purchase", "error"), "tool.completed").when(kind == "view", "tool.observed").otherwise("message.user").alias("kind"),
        F.when(tool, F.concat(F.lit("c"), F.col("user_id").cast("string"), F.lit(":"), k)).alias("call_id"), F.when(F.col("k") % 2 == 0, "shell").otherwise("editor").alias("tool"),
        F.when(kind != "signup", pick(F.concat(F.lit("pytest tests/"), k), F.concat(F.lit("ls  -la "), k), F.concat(F.lit("cd x && npm  test "), k), F.concat(F.lit("echo Testing "), k))).alias("command"),
        F.when(kind == "click", "REQUESTED").when(kind.isin("purchase", "view"), "COMPLETED").when(kind == "error", "FAILED").alias("status"),
        F.when(kind == "purchase", 0).when((kind == "error") & (F.col("value") > 50), 1).alias("exit_code"),
        F.when(kind == "signup", F.when(F.col("k") % 7 == 0, F.concat(F.lit("<environment_context> "), k)).when(F.col("k") % 5 == 0, F.concat(F.lit("noise\n## My request: item "), k)).otherwise(F.concat(F.lit("  please do item "), k, F.lit(" ")))).alias("text"),
        "k", "value")


_C = """WITH e0 AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
c AS (SELECT 'e' || event_id AS event_id, 's' || user_id AS session_id, ts AS observed_at,
CASE WHEN event_type = 'click' THEN 'tool.requested' WHEN event_type IN ('purchase', 'error') THEN 'tool.completed' WHEN event_type = 'view' THEN 'tool.observed' ELSE 'message.user' END AS kind,
CASE WHEN event_type IN ('click', 'purchase', 'error') THEN 'c' || user_id || ':' || k END AS call_id, CASE WHEN k % 2 = 0 THEN 'shell' ELSE 'editor' END AS tool,
CASE WHEN event_type <> 'signup' THEN CASE k % 4 WHEN 0 THEN 'pytest tests/' || k WHEN 1 THEN 'ls  -la ' || k WHEN 2 THEN 'cd x && npm  test ' || k ELSE 'echo Testing ' || k END END AS command,
CASE WHEN event_type = 'click' THEN 'REQUESTED' WHEN event_type IN ('purchase', 'view') THEN 'COMPLETED' WHEN event_type = 'error' THEN 'FAILED' END AS status,
CASE WHEN event_type = 'purchase' THEN 0 WHEN event_type = 'error' AND value > 50 THEN 1 END AS exit_code,
CASE WHEN event_type = 'signup' THEN CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN 'item ' || k ELSE 'please do item ' || k END END AS request, k, value FROM e0)"""
_T = _C + """, g AS (SELECT call_id, arg_min(CASE WHEN kind = 'tool.requested' THEN event_id ELSE '-' END, (observed_at, event_id)) AS call0, arg_min(session_id, (observed_at, event_id)) AS session_id,
arg_min(tool, (observed_at, event_id)) AS tool, arg_min(command, (observed_at, event_id)) AS command, arg_max(status, (observed_at, event_id)) AS s, arg_min(observed_at, (observed_at, event_id)) AS started_at,
arg_max(event_id, (observed_at, event_id)) FILTER (kind = 'tool.completed') AS result_event, max(observed_at) FILTER (kind = 'tool.completed') AS ended_at,
arg_max(exit_code, (observed_at, event_id)) FILTER (exit_code IS NOT NULL) AS exit_code FROM c WHERE call_id IS NOT NULL GROUP BY call_id),
tools AS (SELECT call_id, nullif(call0, '-') AS call_event, session_id, tool, command, result_event, exit_code, started_at, ended_at, CASE WHEN s = 'REQUESTED' AND result_event IS NULL THEN 'INCOMPLETE' ELSE s END AS status,
'fp-' || left(sha256(tool || '|' || command), 24) AS fingerprint FROM g)"""


@query(_T + " SELECT call_id, call_event, session_id, tool, command, result_event, exit_code, status, fingerprint FROM tools")
def case_tools(spark, sf_dir):
    return ledger.tools(case_events(spark, sf_dir), order()).drop("started_at", "ended_at")


@query(_T + """ SELECT fingerprint, tool, count(*) AS attempts, count(*) FILTER (status = 'FAILED') AS failures, epoch_us(min(started_at)) AS first_us, epoch_us(max(coalesce(ended_at, started_at))) AS last_us, max(status) AS terminal_status
FROM tools GROUP BY fingerprint, tool HAVING count(*) >= 3""")
def case_repetitions(spark, sf_dir):
    out = ledger.repetitions(ledger.tools(case_events(spark, sf_dir), order()))
    return out.withColumn("first_us", F.unix_micros("first_at")).withColumn("last_us", F.unix_micros("last_at")).drop("first_at", "last_at")


@query(_C + """, m AS (SELECT event_id, kind, last_value(CASE WHEN kind = 'tool.requested' THEN call_id END IGNORE NULLS) OVER (PARTITION BY session_id, command ORDER BY observed_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS matched_call
FROM c WHERE kind IN ('tool.requested', 'tool.observed')) SELECT event_id, matched_call FROM m WHERE kind = 'tool.observed'""")
def observed_calls(spark, sf_dir):
    return ledger.observed_calls(case_events(spark, sf_dir), order()).select("event_id", "matched_call")


_IS_VALIDATION = "(command LIKE 'pytest %' OR command LIKE 'cd x && npm  test %')"
_COMPACT = "trim(regexp_replace(command, '\\s+', ' ', 'g'))"
_V = _T + f""", seen AS (SELECT event_id, call_id, session_id, command, status, exit_code, session_id || '|' || lower({_COMPACT}) AS key FROM c WHERE kind = 'tool.observed' AND {_IS_VALIDATION}),
own AS (SELECT coalesce(result_event, call_event) AS event_id, call_id, session_id, command, status, exit_code FROM tools WHERE {_IS_VALIDATION} AND session_id || '|' || lower({_COMPACT}) NOT IN (SELECT key FROM seen)),
val AS (SELECT event_id, call_id, session_id, 'historical-tool' AS origin, command, status, exit_code FROM own UNION ALL SELECT event_id, call_id, session_id, 'historical-observation', command, status, exit_code FROM seen),
validations AS (SELECT 'val-' || left(sha256(origin || '|' || coalesce(event_id, call_id)), 16) AS validation_id, event_id, session_id, origin, 'historical command: ' || left({_COMPACT}, 180) AS target,
CASE WHEN exit_code = 0 THEN 'OBSERVED_PASS' WHEN exit_code IS NOT NULL THEN 'OBSERVED_FAIL' WHEN status = 'FAILED' THEN 'OBSERVED_FAIL' WHEN status = 'INCOMPLETE' THEN 'INCOMPLETE' ELSE 'OBSERVED_PASS' END AS status FROM val)"""


def _validations(spark, sf_dir):
    events = case_events(spark, sf_dir)
    return ledger.validations(ledger.tools(events, order()), events.where("kind = 'tool.observed'"))


@query(_V + " SELECT validation_id, event_id, session_id, origin, target, status FROM validations")
def case_validations(spark, sf_dir):
    return _validations(spark, sf_dir)


_TASKS = _C + """, w AS (SELECT *, count(*) FILTER (kind = 'message.user') OVER (PARTITION BY session_id ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM c WHERE kind IN ('message.user', 'tool.requested')),
g AS (SELECT session_id, turn, max(event_id) FILTER (kind = 'message.user') AS requested_event, max(request) AS request, max(observed_at) FILTER (kind = 'message.user') AS o, arg_max(event_id, (observed_at, event_id)) FILTER (kind = 'tool.requested') AS last_event FROM w WHERE turn > 0 GROUP BY session_id, turn)
SELECT 'tsk-' || left(sha256(requested_event), 16) AS task_id, session_id, requested_event, request, last_event, (1001 - row_number() OVER (PARTITION BY session_id ORDER BY o, requested_event))::INTEGER AS priority,
CASE WHEN last_event IS NULL THEN 'REQUESTED' ELSE 'ATTEMPTED' END AS state FROM g WHERE request IS NOT NULL"""


@query(_TASKS)
def case_tasks(spark, sf_dir):
    return ledger.tasks(case_events(spark, sf_dir), order())


_STEMS = "list_distinct(list_filter(list_transform(regexp_extract_all(lower({0}), '[a-z0-9_-]{{4,}}'), lambda x: regexp_replace(x, '(ments?|ations?|ions?|ing|ed|es|s)$', '')), lambda x: length(x) >= 4))"


def _executions(events: DataFrame) -> DataFrame:
    rows = events.where("kind = 'tool.completed'").withColumn("fingerprint", F.concat_ws("|", "tool", "command"))
    return rows.select(F.col("event_id").alias("call_id"), "session_id", F.unix_micros("observed_at").alias("at"), F.concat_ws(" ", "tool", "command").alias("text"), "status", "fingerprint")


@query(_C + f""", x AS (SELECT event_id, session_id, epoch_us(observed_at) AS at, status, tool || '|' || command AS fp, {_STEMS.format("tool || ' ' || command")} AS st FROM c WHERE kind = 'tool.completed'),
r AS (SELECT event_id, session_id, epoch_us(observed_at) AS at, {_STEMS.format("request || ' tested shells'")} AS st FROM c WHERE kind = 'message.user' AND request IS NOT NULL)
SELECT r.event_id AS claim_id, f.event_id AS call_id FROM r JOIN x f ON f.session_id = r.session_id AND f.at < r.at AND f.status = 'FAILED' AND len(list_intersect(f.st, r.st)) > 0
WHERE NOT EXISTS (SELECT 1 FROM x s WHERE s.status = 'COMPLETED' AND s.session_id = f.session_id AND s.fp = f.fp AND s.at > f.at AND s.at < r.at)""")
def case_contradictions(spark, sf_dir):
    events = case_events(spark, sf_dir)
    said = events.where("kind = 'message.user'").withColumn("request", reading.substantive(F.col("text"))).where("request is not null")
    reports = said.select(F.col("event_id").alias("claim_id"), "session_id", F.unix_micros("observed_at").alias("at"), F.concat(F.col("request"), F.lit(" tested shells")).alias("text"))
    return ledger.contradictions(reports, _executions(events))


def _touches(spark, sf_dir):
    e = case_events(spark, sf_dir).where("kind <> 'message.user'")
    suffix = F.element_at(F.array(*map(F.lit, ("md", "json", "sql", "png", "py"))), (F.col("k") % 5 + 1).cast("int"))
    root = F.concat(F.lit(_ROOT), "session_id")
    return e.select(root.alias("root"), F.concat(root, F.lit("/src/f"), (F.col("k") % 10).cast("string"), F.lit("."), suffix).alias("path"), "event_id", F.when(F.col("k") % 3 == 0, "CREATE").otherwise("UPDATE").alias("operation"),
                    F.when(F.col("k") % 4 != 1, F.sha2(F.col("k").cast("string"), 256)).alias("sha256"), F.when(F.col("status") == "FAILED", "FAILED").otherwise("LIVE_UNVERIFIED").alias("status"), "observed_at")


_A = _C + """, touch AS (SELECT '/w/' || session_id AS root, 'src/f' || (k % 10) || '.' || list_extract(['md', 'json', 'sql', 'png', 'py'], (k % 5 + 1)::BIGINT) AS logical_path, event_id, CASE WHEN k % 3 = 0 THEN 'CREATE' ELSE 'UPDATE' END AS operation,
CASE WHEN k % 4 <> 1 THEN sha256(k::VARCHAR) END AS sha, CASE WHEN status = 'FAILED' THEN 'FAILED' ELSE 'LIVE_UNVERIFIED' END AS status, observed_at FROM c WHERE kind <> 'message.user'),
art AS (SELECT 'art-' || left(sha256(root || '|' || logical_path), 24) AS artifact_id, root, logical_path, arg_max(status, (observed_at, event_id)) AS current_status, arg_max(sha, (observed_at, event_id)) FILTER (sha IS NOT NULL) AS current_sha256 FROM touch GROUP BY root, logical_path),
rev AS (SELECT *, 'art-' || left(sha256(root || '|' || logical_path), 24) AS artifact_id, 'rev-' || left(sha256('art-' || left(sha256(root || '|' || logical_path), 24) || '|' || event_id || '|' || operation || '|' || coalesce(sha, '')), 24) AS revision_id FROM touch),
chain AS (SELECT artifact_id, revision_id, event_id, operation, lag(revision_id) OVER w AS predecessor, lag(event_id) OVER w AS predecessor_event, row_number() OVER w AS number FROM rev WINDOW w AS (PARTITION BY artifact_id ORDER BY observed_at, event_id, revision_id))"""


@query(_A + """ SELECT artifact_id, root, logical_path, root || '/' || logical_path AS current_path, current_status, current_sha256,
CASE WHEN logical_path LIKE '%.md' THEN 'DOCUMENT' WHEN logical_path LIKE '%.json' THEN 'CONFIGURATION' WHEN logical_path LIKE '%.sql' THEN 'SCHEMA' WHEN logical_path LIKE '%.png' THEN 'MEDIA' ELSE 'FILE' END AS kind FROM art""")
def case_artifacts(spark, sf_dir):
    return ledger.artifacts(_touches(spark, sf_dir), order()).drop("first_seen", "last_seen")


@query(_A + " SELECT artifact_id, revision_id, event_id, predecessor, number::INTEGER AS number FROM chain")
def case_revisions(spark, sf_dir):
    return ledger.revisions(_touches(spark, sf_dir), order()).select("artifact_id", "revision_id", "event_id", "predecessor", "number")


@query(_A + """, looked AS (SELECT artifact_id, CASE WHEN logical_path LIKE '%.png' THEN NULL WHEN logical_path LIKE '%.md' THEN sha256('changed') ELSE current_sha256 END AS sha FROM art WHERE logical_path NOT LIKE '%.sql'),
now AS (SELECT a.root, a.logical_path, CASE WHEN l.artifact_id IS NULL THEN a.current_status WHEN l.sha IS NULL THEN 'MISSING' WHEN l.sha = a.current_sha256 THEN 'LIVE_VERIFIED' ELSE 'LIVE_UNVERIFIED' END AS current_status FROM art a LEFT JOIN looked l USING (artifact_id))
SELECT root, logical_path, current_status, row_number() OVER (PARTITION BY root ORDER BY list_position(['MISSING', 'LIVE_VERIFIED', 'LIVE_UNVERIFIED', 'FAILED', 'SUPERSEDED', 'UNKNOWN'], current_status), logical_path)::INTEGER AS rank FROM now""")
def case_current_state(spark, sf_dir):
    """A look at the workspace: pictures are gone, documents changed, schemas were not looked for."""
    art = ledger.artifacts(_touches(spark, sf_dir), order())
    sha = F.when(F.col("kind") == "MEDIA", F.lit(None).cast("string")).when(F.col("kind") == "DOCUMENT", F.sha2(F.lit("changed"), 256)).otherwise(F.col("current_sha256"))
    seen = art.where("kind <> 'SCHEMA'").select("artifact_id", F.col("current_path").alias("path"), sha.alias("sha256"))
    return ledger.by_priority(ledger.current_state(art, seen), ["root"]).select("root", "logical_path", "current_status", "rank")


@query(_V + _A.removeprefix(_C) + """ SELECT call_event AS src, result_event AS dst, 'RESULT_OF' AS type FROM tools WHERE call_event IS NOT NULL AND result_event IS NOT NULL
UNION ALL SELECT event_id, validation_id, 'VALIDATED' FROM validations WHERE event_id IS NOT NULL UNION ALL SELECT event_id, artifact_id, CASE WHEN operation = 'CREATE' THEN 'PRODUCED' ELSE 'MODIFIED' END FROM chain
UNION ALL SELECT predecessor_event, event_id, 'SUPERSEDES' FROM chain WHERE predecessor_event <> event_id""")
def case_edges(spark, sf_dir):
    return graph.union(ledger.result_edges(ledger.tools(case_events(spark, sf_dir), order())), ledger.validation_edges(_validations(spark, sf_dir)), ledger.revision_edges(ledger.revisions(_touches(spark, sf_dir), order())))


@query("""SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(event_id, (ts, event_id)) AS last_id, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY ALL""")
def keep_first_last(spark, sf_dir):
    """Insert or ignore, and insert or replace, of whole rows."""
    e, by = t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts"), F.struct("ts", "event_id")
    first = ledger.keep_first(e, ["user_id", "event_type"], by).select("user_id", "event_type", F.col("event_id").alias("first_id"), F.col("value").alias("first_value"))
    return first.join(ledger.keep_last(e, ["user_id", "event_type"], by).select("user_id", "event_type", F.col("event_id").alias("last_id"), F.col("value").alias("last_value")), ["user_id", "event_type"])


_TERMS = "list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@query(f"""WITH d AS (SELECT conv_id, turn, ' ' || array_to_string({_TERMS}, ' ') || ' ' AS x FROM conversations), h AS (SELECT conv_id, turn FROM d WHERE contains(x, ' de la ') AND contains(x, ' etion '))
SELECT conv_id, turn, row_number() OVER (ORDER BY lpad(turn::VARCHAR, 9, '0'), conv_id)::INTEGER AS rank FROM h QUALIFY rank <= 100""")
def indexed_search(spark, sf_dir):
    """Two phrases through the index of terms, the first hundred hits in the order of turns."""
    c = t(spark, sf_dir, "conversations").withColumn("event_id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).withColumn("at", F.lpad(F.col("turn").cast("string"), 9, "0"))
    found = search.matches(search.term_index(c, ["text"]), "de-la étion")
    return search.in_time_order(c, found, ["at", "conv_id"], search.candidate_limit(5)).select("conv_id", "turn", "rank")


_NEAR = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query, v.vec_id AS id, round(list_cosine_similarity(v.e, q.e), 9) AS similarity FROM v, v q WHERE q.vec_id % 20 = 0) """


@query(_NEAR + "SELECT query, id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY s.similarity DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 10")
def knn_queries(spark, sf_dir):
    """The ten nearest vectors of every twentieth one."""
    v = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return semantic.nearest(v, v.where("id % 20 = 0"), 10, floor=None).withColumn("similarity", F.round("similarity", 6))


@query(_NEAR + "SELECT query, count(*) AS n, round(min(similarity), 6) AS least FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM s WHERE similarity >= 0.15 QUALIFY rank <= 50) GROUP BY query")
def knn_above_floor(spark, sf_dir):
    v = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return semantic.nearest(v, v.where("id % 20 = 0"), 50).groupBy("query").agg(F.count("*").alias("n"), F.round(F.min("similarity"), 6).alias("least"))


_R = """WITH r AS (SELECT conv_id AS source, turn AS ordinal, text AS line, sha256(coalesce(text, '')) AS sha FROM conversations),
held AS (SELECT source, ordinal, CASE WHEN (source * 31 + ordinal) % 97 = 5 THEN line || ' tampered' ELSE line END AS line FROM r WHERE (source + ordinal) % 101 <> 3),
refs AS (SELECT source, ordinal, CASE WHEN source % 41 = 6 THEN 'wrong' ELSE sha END AS sha FROM r WHERE ordinal % 53 <> 7) """


def _case(spark, sf_dir):
    """Records of conversations; what is stored of them, some altered and some lost; their references, some wrong."""
    r = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source"), F.col("turn").alias("ordinal"), F.col("text").alias("line"))
    records = r.withColumn("sha256", F.sha2(F.coalesce("line", F.lit("")), 256)).withColumn("byte_length", F.octet_length("line"))
    held = r.where((F.col("source") + F.col("ordinal")) % 101 != 3).withColumn("line", F.when((F.col("source") * 31 + F.col("ordinal")) % 97 == 5, F.concat("line", F.lit(" tampered"))).otherwise(F.col("line")))
    refs = records.where(F.col("ordinal") % 53 != 7).withColumn("sha256", F.when(F.col("source") % 41 == 6, "wrong").otherwise(F.col("sha256")))
    return records.drop("line"), held, refs.select("source", "ordinal", "sha256")


@query(_R + """, f AS (SELECT 'source.records' AS "check", count(*) FILTER (h.line IS NULL OR sha256(h.line) <> r.sha) AS n, ' record(s) whose bytes are missing or disagree' AS what FROM r LEFT JOIN held h USING (source, ordinal)
UNION ALL SELECT 'evidence.refs', count(*) FILTER (r.sha IS NULL OR r.sha <> e.sha), ' missing or hash-disagreeing reference(s)' FROM refs e LEFT JOIN r USING (source, ordinal)
UNION ALL SELECT 'records.evidence_coverage', count(*), ' source record(s) without an evidence reference' FROM r WHERE NOT EXISTS (SELECT 1 FROM refs e WHERE e.source = r.source AND e.ordinal = r.ordinal)
UNION ALL SELECT 'graph.edges', (SELECT count(*) FROM orders WHERE o_custkey % 50 = 0), ' edge end(s) without a node'
UNION ALL SELECT 'manifest.metrics', 1, ' count(s) that disagree with the manifest')
SELECT "check", n = 0 AS ok, n || what AS detail FROM f""")
def case_integrity(spark, sf_dir):
    """Checks of a damaged case: every kind of damage is told."""
    records, held, refs = _case(spark, sf_dir)
    o = t(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst"))
    customers = t(spark, sf_dir, "orders").where("o_custkey % 50 <> 0").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    counted = ledger.count_rows(sourceRecords=records, events=held)
    manifest = counted.withColumn("n", F.when(F.col("name") == "events", F.col("n") + 1).otherwise(F.col("n")))
    return checks.all_findings(checks.records(held, records), checks.references(refs, records), checks.coverage(records, refs), checks.edge_ends(o, checks.all_nodes(o.select("src"), customers), "graph.edges"), checks.metrics(counted, manifest))


@query("""WITH d AS (SELECT source, lang, count(*) AS results, count(*) FILTER (l.doc_id IS NULL) AS failures, count(*) FILTER (d.n_chars = 0) AS gaps FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY source, lang)
SELECT source, lang, CASE WHEN results > 0 AND failures = 0 THEN 'VERIFIED_PRESENT' WHEN results > 0 OR gaps > 0 THEN 'INCONCLUSIVE_COVERAGE' ELSE 'NOT_OBSERVED_IN_CAPTURED_EVIDENCE' END AS state FROM d""")
def case_assessment(spark, sf_dir):
    d, known = t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("held", F.lit(True))
    rows = d.join(known, "doc_id", "left").groupBy("source", "lang").agg(F.count("*").alias("results"), F.count_if(F.col("held").isNull()).alias("failures"), F.count_if(F.col("n_chars") == 0).alias("gaps"))
    return rows.select("source", "lang", search.assessed(F.col("results"), F.col("failures"), F.col("gaps")).alias("state"))


@query("""WITH v AS (SELECT doc_id, n_chars::BIGINT * 1000 AS n FROM documents), u AS (SELECT doc_id, n, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 ELSE 3 END AS i FROM v)
SELECT doc_id, CASE WHEN i = 0 OR n / 1024.0::DOUBLE ** i >= 10 THEN round(n / 1024.0::DOUBLE ** i)::BIGINT::VARCHAR ELSE round(n / 1024.0::DOUBLE ** i, 1)::VARCHAR END || ' ' || list_extract(['B', 'KiB', 'MiB', 'GiB'], i + 1) AS size,
(n // 3600000) || 'h ' || (n % 3600000 // 60000) || 'm ' || (n % 60000 // 1000) || 's' AS duration FROM u""")
def sizes_and_durations(spark, sf_dir):
    n = F.col("n_chars").cast("long") * 1000
    return t(spark, sf_dir, "documents").select("doc_id", reading.size_text(n).alias("size"), reading.duration_text(n).alias("duration"))


_PLAIN = "regexp_replace(regexp_replace(text, '\\r\\n', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g')"


@query(f"""WITH p AS (SELECT doc_id, {_PLAIN} AS x FROM documents) SELECT doc_id, sha256(CASE WHEN length(x) > 1200
THEN left(x, 840) || chr(10) || '…[' || (length(x) - 1200) || ' chars omitted from projection; raw evidence retained]…' || chr(10) || right(x, 360) ELSE x END) AS preview_sha256 FROM p""")
def previews(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2(reading.elided(F.col("text")), 256).alias("preview_sha256"))


@query(f"""SELECT conv_id, turn, len(a) AS n_stems, len(list_intersect(a, b)) > 0 AS related FROM
(SELECT c.conv_id, c.turn, {_STEMS.format("coalesce(c.text, '')")} AS a, {_STEMS.format("coalesce(d.text, '')")} AS b FROM conversations c JOIN conversations d ON d.conv_id = c.conv_id AND d.turn = c.turn + 1)""")
def related_turns(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.size(reading.stems(F.col("text"))).cast("long").alias("n_stems"), reading.related(F.col("text"), F.col("next")).alias("related"))


@query("""SELECT 1 AS step, 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'PLACED_BY' AS type, false AS reverse FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)
UNION ALL SELECT 2, 'c' || c_custkey, 'n' || c_nationkey, 'IN_NATION', false FROM customer WHERE c_custkey = (SELECT arg_min(o_custkey, o_orderkey) FROM orders)
UNION ALL SELECT 3, 'n' || n_nationkey, 'r' || n_regionkey, 'IN_REGION', false FROM nation WHERE n_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = (SELECT arg_min(o_custkey, o_orderkey) FROM orders))""")
def shortest_path(spark, sf_dir):
    """From the first order to its region."""
    from caselake.plans.catalog import _edges

    first = t(spark, sf_dir, "orders").agg(F.min("o_orderkey").alias("o"), F.min_by("o_custkey", "o_orderkey").alias("c")).first()
    place = t(spark, sf_dir, "customer").where(F.col("c_custkey") == first.c).join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey").first()
    return graph.path(_edges(spark, sf_dir), f"o{first.o}", f"r{place.n_regionkey}")


@query("""WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 100), b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id DESC) AS r FROM documents QUALIFY r <= 100),
g AS (SELECT doc_id AS id, 1 / (60.0::DOUBLE + doc_id) AS contribution FROM documents WHERE doc_id % 50 = 0),
s AS (SELECT id, coalesce(1 / (60.0::DOUBLE + a.r), 0) + coalesce(1 / (60.0::DOUBLE + b.r), 0) + coalesce(contribution, 0) AS score FROM a FULL JOIN b USING (id) FULL JOIN g USING (id)) SELECT id, round(score, 9) AS score FROM s ORDER BY s.score DESC, id LIMIT 25""")
def hybrid_search(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    a, b = retrieval.ranked_top(d, [F.desc("n_chars"), "id"], 100), retrieval.ranked_top(d, [F.desc("id")], 100)
    g = d.where("id % 50 = 0").select("id", (1 / (60 + F.col("id"))).alias("contribution"))
    return search.hybrid(a, b, g, 25, key="id").select("id", F.round("score", 9).alias("score"))
