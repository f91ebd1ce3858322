"""The queries of the engine's own operators, bound to the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselake.functions import text as fn
from caselake.operators import events as ev
from caselake.operators import graph, retrieval
from caselake.sources import jsonl, transcripts

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


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with k, the number in their properties."""
    return t(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


_KEYED = "WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) "
_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"


@query(f"""WITH e AS (SELECT *, CASE role WHEN 'user' THEN 'message.user' WHEN 'assistant' THEN 'message.agent' ELSE 'message.instruction' END AS kind FROM conversations)
SELECT 'evt-' || left(sha256(conv_id || '|' || turn || '|' || kind), 24) AS event_id, 'ses:generic:' || conv_id AS session_id, turn AS ordinal, kind, sha256(coalesce(text, '')) AS content_sha256,
'case://conversations/' || conv_id || '#record=' || turn AS evidence_uri FROM e WHERE list_contains({_TOKENS}, 'the') AND list_contains({_TOKENS}, 'and')""")
def entry_search(spark, sf_dir):
    found = retrieval.lexical(ev.canonical_events(t(spark, sf_dir, "conversations")), ["the", "and"])
    return found.where(F.col("content_sha256") == fn.sha256(F.col("text"))).select("event_id", "session_id", "ordinal", "kind", "content_sha256", "evidence_uri").orderBy("session_id", "ordinal")


@query("""WITH e AS (SELECT *, CASE role WHEN 'user' THEN 'message.user' WHEN 'assistant' THEN 'message.agent' ELSE 'message.instruction' END AS kind FROM conversations)
SELECT 'evt-' || left(sha256(conv_id || '|' || turn || '|' || kind), 24) AS event_id, 'ses:generic:' || conv_id AS session_id, turn AS ordinal, kind,
CASE role WHEN 'user' THEN 'USER' WHEN 'assistant' THEN 'PRIMARY_AGENT' ELSE 'SYSTEM' END AS actor_kind, sha256(coalesce(text, '')) AS content_sha256,
'case://conversations/' || conv_id || '#record=' || turn AS evidence_uri FROM e""")
def canonical_events(spark, sf_dir):
    return ev.canonical_events(t(spark, sf_dir, "conversations")).drop("text")


@query("""SELECT conv_id, turn, sha256(text) AS sha256, strlen(text)::BIGINT AS byte_length,
coalesce(sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM conversations""")
def record_accounting(spark, sf_dir):
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("text").cast("long")
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("sha256"), size.alias("byte_length"), F.coalesce(F.sum(size + 1).over(before), F.lit(0)).alias("byte_offset"))


@query(_KEYED + "SELECT event_id, k FROM e")
def event_metadata_json(spark, sf_dir):
    return keyed(spark, sf_dir).select("event_id", "k")


@query("SELECT event_id, (epoch_us(ts) // 1000) AS observed_ms, CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN 'MILLISECOND' ELSE 'SECOND' END AS time_precision FROM events")
def timestamp_normalize(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return t(spark, sf_dir, "events").select("event_id", fn.epoch_ms(ts).alias("observed_ms"), fn.precision(ts).alias("time_precision"))


_SECRET = '(token|api_key|password|secret) = "[0-9a-f]+"'


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_SECRET}'))::BIGINT AS findings, sha256(regexp_replace(text, '{_SECRET}', '[REDACTED]', 'g')) AS redacted_sha256 FROM documents")
def redact_documents(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(_SECRET)).cast("long").alias("findings"), F.sha2(F.regexp_replace("text", _SECRET, "[REDACTED]"), 256).alias("redacted_sha256"))


@query("SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", fn.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT event_id, event_type FROM events WHERE event_type LIKE 'p%' OR event_type LIKE 'er%'")
def kind_prefix_filter(spark, sf_dir):
    return t(spark, sf_dir, "events").where(F.col("event_type").startswith("p") | F.col("event_type").startswith("er")).select("event_id", "event_type")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'view') AND user_id BETWEEN 10 AND 90 AND value >= 10")
def structured_filter(spark, sf_dir):
    return t(spark, sf_dir, "events").where("event_type in ('click', 'view') and user_id between 10 and 90 and value >= 10").select("event_id", "user_id", "event_type")


@query("""SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_event_type, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS last_value FROM events GROUP BY user_id""")
def session_merge(spark, sf_dir):
    return ev.merged(t(spark, sf_dir, "events"), ["user_id"], F.struct("ts", "event_id"), ["event_type"], ["value"])


_PAIRS = _KEYED + """, p AS (SELECT event_id, user_id, k, event_type, first_value(CASE WHEN event_type IN ('purchase', 'error') THEN event_id END IGNORE NULLS)
OVER (PARTITION BY user_id, k ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS result_id FROM e) """


def _pairs(spark, sf_dir):
    return ev.next_result(keyed(spark, sf_dir), ["user_id", "k"], ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type").isin("purchase", "error"), "event_id")


@query(_PAIRS + "SELECT event_id AS call_id, result_id FROM p WHERE event_type = 'click' AND result_id IS NOT NULL")
def tool_pairing(spark, sf_dir):
    return _pairs(spark, sf_dir).where("__result is not null").select(F.col("event_id").alias("call_id"), F.col("__result").alias("result_id"))


@query(_PAIRS + "SELECT event_id AS call_id, 'INCOMPLETE' AS status FROM p WHERE event_type = 'click' AND result_id IS NULL")
def incomplete_tools(spark, sf_dir):
    return _pairs(spark, sf_dir).where("__result is null").select(F.col("event_id").alias("call_id"), F.lit("INCOMPLETE").alias("status"))


@query(_KEYED + """SELECT user_id, event_type, k, count(*) AS attempts, count(*) FILTER (value > 50) AS high, min((epoch_us(ts) // 1000)) AS first_ms, max((epoch_us(ts) // 1000)) AS last_ms
FROM e GROUP BY ALL HAVING count(*) >= 3""")
def repetition_groups(spark, sf_dir):
    ms = fn.epoch_ms(F.col("ts").cast("timestamp"))
    out = keyed(spark, sf_dir).groupBy("user_id", "event_type", "k").agg(F.count("*").alias("attempts"), F.count_if(F.expr("value > 50")).alias("high"), F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"))
    return out.where("attempts >= 3")


@query("""WITH RECURSIVE r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY o) AS i FROM r),
f AS (SELECT event_id, user_id, event_type, o, i, o AS anchor, false AS duplicate FROM n WHERE i = 1
UNION ALL SELECT n.event_id, n.user_id, n.event_type, n.o, n.i, CASE WHEN n.o - f.anchor > 20 THEN n.o ELSE f.anchor END, n.o - f.anchor <= 20 FROM f JOIN n ON n.user_id = f.user_id AND n.event_type = f.event_type AND n.i = f.i + 1)
SELECT event_id, duplicate FROM f""")
def anchored_dedupe(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("o"))
    return ev.anchored_duplicates(rows, ["user_id", "event_type"], "o", 20).select("event_id", "duplicate")


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS occurrences FROM documents GROUP BY ALL")
def content_dedupe(spark, sf_dir):
    return t(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("occurrences"))


@query("SELECT conv_id, sha256(arg_min(text, turn)) AS first_request, sha256(arg_max(text, turn)) AS last_request FROM conversations WHERE role = 'user' GROUP BY conv_id")
def first_last_request(spark, sf_dir):
    users = t(spark, sf_dir, "conversations").where("role = 'user'")
    return users.groupBy("conv_id").agg(F.sha2(F.min_by("text", "turn"), 256).alias("first_request"), F.sha2(F.max_by("text", "turn"), 256).alias("last_request"))


@query("""WITH w AS (SELECT *, min(turn) FILTER (role = 'user') OVER f AS next_user, min(turn) FILTER (role = 'assistant') OVER f AS next_agent FROM conversations
WINDOW f AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT 'ses:generic:' || conv_id AS session_id, turn AS ordinal, coalesce(next_user, -1) AS next_user, CASE WHEN next_agent IS NOT NULL AND (next_user IS NULL OR next_agent < next_user) THEN 'ATTEMPTED' ELSE 'REQUESTED' END AS state FROM w WHERE role = 'user'""")
def task_intervals(spark, sf_dir):
    return ev.user_intervals(ev.canonical_events(t(spark, sf_dir, "conversations"))).drop("event_id").withColumn("next_user", F.coalesce("next_user", F.lit(-1)))


@query("""SELECT page_id, (i - 1)::INTEGER AS position, href[i] AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS href FROM pages), unnest(range(1, len(href) + 1)) AS u(i)""")
def marker_extract(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("position", "href"))


@query(_KEYED + """SELECT f.event_id AS failure_id, r.event_id AS report_id FROM e f JOIN e r ON r.user_id = f.user_id AND r.k = f.k AND r.ts > f.ts
WHERE f.event_type = 'error' AND r.event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM e x WHERE x.event_type = 'signup' AND x.user_id = f.user_id AND x.k = f.k AND x.ts > f.ts AND x.ts < r.ts)""")
def contradictions(spark, sf_dir):
    rows = keyed(spark, sf_dir).withColumnRenamed("event_id", "id")
    part = lambda kind: rows.where(F.col("event_type") == kind)
    return ev.contradictions(part("error"), part("purchase"), part("signup"), ["user_id", "k"], "ts").select("failure_id", "report_id")


@query(_KEYED + "SELECT event_id FROM e WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM e p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.k = e.k)")
def validations_antijoin(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    return rows.where("event_type = 'click'").join(rows.where("event_type = 'purchase'").select("user_id", "k"), ["user_id", "k"], "left_anti").select("event_id")


@query("SELECT o_orderkey, o_custkey, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), -1) AS predecessor, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS revision FROM orders")
def revision_chain(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.coalesce(F.lag("o_orderkey").over(w), F.lit(-1)).alias("predecessor"), F.row_number().over(w).alias("revision"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY o_custkey")
def latest_revision(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def coverage_uncovered(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id").join(t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT l_returnflag, count(*) AS orphans, sum(l_linenumber)::BIGINT AS lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_returnflag")
def orphan_refs(spark, sf_dir):
    known = t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t(spark, sf_dir, "lineitem").join(known, "l_orderkey", "left_anti").groupBy("l_returnflag").agg(F.count("*").alias("orphans"), F.sum("l_linenumber").alias("lines"))


def _edges(spark, sf_dir):
    n, c, o = (t(spark, sf_dir, x) for x in ("nation", "customer", "orders"))
    node = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    return graph.union(
        n.select(node("n", "n_nationkey").alias("src"), node("r", "n_regionkey").alias("dst"), F.lit("IN_REGION").alias("type")),
        c.select(node("c", "c_custkey").alias("src"), node("n", "c_nationkey").alias("dst"), F.lit("IN_NATION").alias("type")),
        o.select(node("o", "o_orderkey").alias("src"), node("c", "o_custkey").alias("dst"), F.lit("PLACED_BY").alias("type")))


_EDGES = """WITH RECURSIVE edges AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'IN_REGION' AS type FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'IN_NATION' FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'PLACED_BY' FROM orders)"""


@query(_EDGES + " SELECT src, dst, type FROM edges")
def edge_union(spark, sf_dir):
    return _edges(spark, sf_dir)


_WALK = _EDGES + """, steps AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
walk AS (SELECT 'n3' AS node, 0 AS depth UNION SELECT s.dst, w.depth + 1 FROM walk w JOIN steps s ON s.src = w.node WHERE w.depth < 3) """


@query(_WALK + "SELECT node, min(depth)::INTEGER AS depth FROM walk GROUP BY node")
def graph_neighbors(spark, sf_dir):
    return graph.neighbors(_edges(spark, sf_dir), "n3", 3)


@query(_EDGES + """, b AS (SELECT left(sha256(src), 4) AS b, sha256(string_agg(src || '|' || dst || '|' || type, chr(10) ORDER BY (src || '|' || dst || '|' || type))) AS d, count(*) AS n FROM edges GROUP BY ALL),
a AS (SELECT left(b, 2) AS a, sha256(string_agg(b || ':' || d, chr(10) ORDER BY b)) AS d, sum(n) AS n FROM b GROUP BY ALL)
SELECT sha256(string_agg(a || ':' || d, chr(10) ORDER BY a)) AS identity, sum(n)::BIGINT AS edges FROM a""")
def graph_identity(spark, sf_dir):
    return graph.identity(_edges(spark, sf_dir))


@query(_EDGES + " SELECT left(node, 1) AS kind, count(*) AS nodes FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) GROUP BY ALL")
def node_union(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().groupBy(F.substring("node", 1, 1).alias("kind")).agg(F.count("*").alias("nodes"))


@query(f"SELECT doc_id FROM documents WHERE list_contains({_TOKENS}, 'the') AND contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' of the ')")
def lexical_search(spark, sf_dir):
    return retrieval.lexical(t(spark, sf_dir, "documents"), ["the", "of the"]).select("doc_id")


@query(f"SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY token")
def inverted_index_stats(spark, sf_dir):
    return retrieval.inverted_index(t(spark, sf_dir, "documents"), "doc_id", "text")


def _similar(spark, sf_dir):
    v = t(spark, sf_dir, "embeddings")
    return retrieval.similar(v, v.where("vec_id = 0").select(F.col("embedding").alias("q")))


_SIMILAR = "WITH s AS (SELECT v.vec_id, v.label, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) "


@query(_SIMILAR + "SELECT vec_id, round(similarity, 5) AS similarity FROM s ORDER BY s.similarity DESC, vec_id LIMIT 10")
def knn_topk(spark, sf_dir):
    return _similar(spark, sf_dir).orderBy(F.desc("similarity"), "vec_id").limit(10).select("vec_id", F.round("similarity", 5).alias("similarity"))


@query(_SIMILAR + "SELECT vec_id FROM s WHERE similarity >= 0.15")
def knn_floor(spark, sf_dir):
    return _similar(spark, sf_dir).where(F.col("similarity") >= retrieval.FLOOR).select("vec_id")


@query(_SIMILAR + "SELECT label, arg_max(vec_id, (similarity, -vec_id)) AS vec_id FROM s GROUP BY label")
def best_per_label(spark, sf_dir):
    return _similar(spark, sf_dir).groupBy("label").agg(F.max_by("vec_id", F.struct("similarity", -F.col("vec_id"))).alias("vec_id"))


@query("""SELECT doc_id, c::INTEGER AS chunk, (c * 1400)::INTEGER AS "begin", sha256(substr(text, (c * 1400 + 1)::BIGINT, 1600)) AS content_sha256
FROM documents, unnest(range(0, greatest(0, ceil((length(text) - 1600) / 1400.0))::BIGINT + 1)) AS u(c)""")
def chunk_fixed(spark, sf_dir):
    return retrieval.fixed_chunks(t(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "chunk", "begin", F.sha2("content", 256).alias("content_sha256"))


@query(_SIMILAR + """, a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 100),
b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM s QUALIFY rank <= 100)
SELECT coalesce(a.id, b.id) AS id, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS score FROM a FULL JOIN b ON a.id = b.id""")
def rrf_fusion(spark, sf_dir):
    a = retrieval.ranked_top(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars"), [F.desc("n_chars"), "id"], 100)
    b = retrieval.ranked_top(_similar(spark, sf_dir).select(F.col("vec_id").alias("id"), "similarity"), [F.desc("similarity"), "id"], 100)
    return retrieval.fused(a, b, "id").select("id", F.round("score", 9).alias("score"))


@query("""SELECT count(*) AS events, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS completed, count(DISTINCT user_id) AS sessions,
(epoch_us(min(ts)) // 1000) AS first_ms, (epoch_us(max(ts)) // 1000) AS last_ms, (epoch_us(max(ts)) // 1000) - (epoch_us(min(ts)) // 1000) AS duration_ms FROM events""")
def case_metrics(spark, sf_dir):
    ms = fn.epoch_ms(F.col("ts").cast("timestamp"))
    return t(spark, sf_dir, "events").agg(F.count("*").alias("events"), F.count_if(F.expr("event_type = 'error'")).alias("failed"), F.count_if(F.expr("event_type = 'purchase'")).alias("completed"), F.countDistinct("user_id").alias("sessions"),
                                          F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"), (F.max(ms) - F.min(ms)).alias("duration_ms"))


@query("""SELECT 'order_customer' AS check_name, count(*) FILTER (c_custkey IS NULL) = 0 AS ok, (count(*) FILTER (c_custkey IS NULL))::BIGINT AS findings FROM orders LEFT JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'line_order_f', count(*) FILTER (o_orderkey IS NULL) = 0, (count(*) FILTER (o_orderkey IS NULL))::BIGINT FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey
UNION ALL SELECT 'document_length', count(*) FILTER (n_chars <> length(text)) = 0, (count(*) FILTER (n_chars <> length(text)))::BIGINT FROM documents
UNION ALL SELECT 'event_ids_unique', count(*) = count(DISTINCT event_id), count(*) - count(DISTINCT event_id) FROM events""")
def integrity_findings(spark, sf_dir):
    o, c, l, d, e = (t(spark, sf_dir, x) for x in ("orders", "customer", "lineitem", "documents", "events"))
    one = lambda df, name, n: df.agg(F.lit(name).alias("check_name"), (n == 0).alias("ok"), n.alias("findings"))
    missing = lambda left, right: left.join(right, "k", "left_anti")
    parts = [
        one(missing(o.select(F.col("o_custkey").alias("k")), c.select(F.col("c_custkey").alias("k"))), "order_customer", F.count("*")),
        one(missing(l.select(F.col("l_orderkey").alias("k")), o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))), "line_order_f", F.count("*")),
        one(d, "document_length", F.count_if(F.expr("n_chars <> length(text)"))),
        one(e, "event_ids_unique", F.count("*") - F.countDistinct("event_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""WITH b AS (SELECT doc_id, source, ceil(length(text) / 4.0)::BIGINT AS tokens, sum(ceil(length(text) / 4.0)) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS used FROM documents)
SELECT doc_id, source, used FROM b WHERE used <= 6000""")
def budget_prefix(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").select("doc_id", "source", fn.token_estimate(F.col("text")).alias("tokens"))
    used = F.sum("tokens").over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).where("used <= 6000").select("doc_id", "source", "used")


@query("SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size < 10 THEN 0 WHEN p_size < 30 THEN 1 ELSE 2 END, p_partkey)::INTEGER AS rank FROM part")
def artifact_priority(spark, sf_dir):
    order = F.when(F.col("p_size") < 10, 0).when(F.col("p_size") < 30, 1).otherwise(2)
    return t(spark, sf_dir, "part").select("p_partkey", "p_brand", F.row_number().over(Window.partitionBy("p_brand").orderBy(order, "p_partkey")).alias("rank"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def state_histogram(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_edges(spark, sf_dir):
    c = t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t(spark, sf_dir, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT DISTINCT event_type FROM events EXCEPT SELECT unnest(['click', 'view'])")
def set_difference(spark, sf_dir):
    expected = spark.createDataFrame([("click",), ("view",)], "event_type string")
    return t(spark, sf_dir, "events").select("event_type").distinct().join(F.broadcast(expected), "event_type", "left_anti")


@query("SELECT page_id, left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS slug FROM pages")
def slugs(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", fn.slug(F.col("url")).alias("slug"))


@query("SELECT event_type, round(avg(value), 6) AS mean_value, quantile_disc(value, 0.5) AS p50 FROM events GROUP BY event_type")
def macro_scores(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/#?]+)', 1) AS host, regexp_extract(url, '^https?://[^/#?]+([^#?]*)', 1) AS path FROM pages")
def address_parse(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/#?]+)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/#?]+([^#?]*)", 1).alias("path"))


@query("""SELECT 'ses:generic:' || conv_id AS session_id, turn AS ordinal, CASE WHEN role = 'user' THEN 'message.user' ELSE 'message.agent' END AS kind,
CASE WHEN role = 'user' THEN 'USER' ELSE 'PRIMARY_AGENT' END AS actor_kind, sha256(coalesce(text, '')) AS input_sha256 FROM conversations""")
def transcript_generic(spark, sf_dir):
    """conversations as lines of a generic transcript, read as any transcript is."""
    turns = t(spark, sf_dir, "conversations")
    line = F.to_json(F.struct(F.col("conv_id").cast("string").alias("session_id"), "role", F.col("text").alias("content")))
    rows = turns.select(F.concat(F.lit("conversations/"), F.col("conv_id").cast("string")).alias("source"), F.col("turn").alias("ordinal"), line.alias("line"))
    found = transcripts.normalized(jsonl.accounted(rows), families=("generic",))
    return found.select("session_id", "ordinal", "kind", "actor_kind", fn.sha256(F.col("input")).alias("input_sha256"))


@query()
def redact_secrets(spark, sf_dir):
    found = fn.redacted(t(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    kinds = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["kind"], f["fingerprint"])), ",")
    return found.select("doc_id", F.size("findings").cast("long").alias("n_findings"), kinds.alias("findings"), fn.sha256(F.col("text")).alias("redacted_sha256"))


@query()
def chunk_words(spark, sf_dir):
    found = retrieval.word_chunks(t(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "chunk", "begin", F.length("content").cast("long").alias("n_chars"), fn.sha256(F.col("content")).alias("content_sha256"))


@query(_EDGES + """, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), s0 AS (SELECT 'n' || n_nationkey AS node, min(n_nationkey + 1) AS seed_rank, 0 AS depth FROM nation WHERE n_regionkey = 0 GROUP BY 1),
s1 AS (SELECT dst AS node, min(seed_rank) AS seed_rank, 1 AS depth FROM b JOIN s0 ON src = node WHERE dst NOT IN (SELECT node FROM s0) GROUP BY dst),
s2 AS (SELECT dst AS node, min(seed_rank) AS seed_rank, 2 AS depth FROM b JOIN s1 ON src = node WHERE dst NOT IN (SELECT node FROM s0 UNION SELECT node FROM s1) GROUP BY dst),
s AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2)
SELECT node, seed_rank, depth, round(1 / (60 + seed_rank + 10 * depth), 9) AS contribution, (SELECT count(*) FROM s) > 500 AS truncated FROM s ORDER BY depth, seed_rank, node LIMIT 500""")
def hybrid_graph(spark, sf_dir):
    """Regions and nations as seeds, expanded over the star schema."""
    seeds = t(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), (F.col("n_nationkey") + 1).alias("rank"))
    return graph.seeded(_edges(spark, sf_dir), seeds, hops=2).withColumn("contribution", F.round("contribution", 9))


from caselake.plans import case_catalog  # noqa: E402

QUERIES |= case_catalog.QUERIES
ORACLES |= case_catalog.ORACLES
