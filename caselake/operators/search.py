"""Search as a case answers it: an index of terms with positions, hits in time order, filters after the candidate
limit, modes that don't fall back silently, and an assessment of what was not found."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselake.functions import reading
from caselake.functions.text import sha256
from caselake.operators.retrieval import RRF

MODES = ("lexical", "semantic", "hybrid")


def term_index(events: DataFrame, columns: list[str], key: str = "event_id") -> DataFrame:
    """term, field, key, positions: one row for each term of a field of an event."""
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), reading.terms(F.coalesce(F.col(c), F.lit(""))).alias("terms")) for c in columns]))
    rows = events.select(key, fields.alias("f")).select(key, "f.field", F.posexplode("f.terms").alias("at", "term"))
    return rows.groupBy("term", "field", key).agg(F.sort_array(F.collect_list("at")).alias("positions"))


def phrases(spark, query: str) -> DataFrame:
    """phrase, size, at, term of a query: what blanks part are phrases, of one term or several."""
    words = spark.createDataFrame([(k, w) for k, w in enumerate(query.split())], "phrase int, w string")
    rows = words.select("phrase", reading.terms(F.col("w")).alias("t")).where(F.size("t") > 0)
    return rows.select("phrase", F.size("t").alias("size"), F.posexplode("t").alias("at", "term"))


def matches(index: DataFrame, query: str, key: str = "event_id") -> DataFrame:
    """Keys of events that hold every phrase of the query, each in one field. Only the index rows of its terms are read
    on: a query has a few."""
    wanted = phrases(index.sparkSession, query)
    n = wanted.select("phrase").distinct().count()
    hits = index.join(F.broadcast(wanted), "term").select(key, "field", "phrase", "size", "at", F.explode("positions").alias("p"))
    whole = hits.groupBy(key, "field", "phrase", "size", (F.col("p") - F.col("at")).alias("begin")).agg(F.count("*").alias("k")).where("k = size")
    return whole.groupBy(key).agg(F.countDistinct("phrase").alias("n")).where(F.col("n") == n).select(key) if n else index.select(key).limit(0)


def candidate_limit(limit: int) -> int:
    return min(1000, max(20 * limit, 100))


def in_time_order(events: DataFrame, found: DataFrame, order: list[str], limit: int, key: str = "event_id") -> DataFrame:
    """The first `limit` hits by time with their rank: rank is a place in time, not relevance."""
    order = [F.coalesce(F.col(order[0]).cast("string"), F.lit("")), *order[1:]]
    return events.join(found, key, "left_semi").orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def time_filter(value: str | None, label: str) -> datetime | None:
    if not value:
        return None
    try:
        found = datetime.fromisoformat(value)
    except ValueError as wrong:
        raise ValueError(f"{label} must be a valid timestamp") from wrong
    return found if found.tzinfo else found.replace(tzinfo=timezone.utc)


def session_filter(sessions: DataFrame, given: str | None) -> str | None:
    """The id of a session named by id or native id, an id first; one that isn't there matches no event."""
    if not given:
        return None
    row = sessions.where((F.col("session_id") == given) | (F.col("native_id") == given)).orderBy((F.col("session_id") != given).cast("int"), "session_id").select("session_id").first()
    return row.session_id if row else f"UNRESOLVED_SESSION:{given}"


def filtered(rows: DataFrame, session: str | None = None, kind: str | None = None, status: str | None = None, actor: str | None = None, since: str | None = None, until: str | None = None,
             refs: DataFrame | None = None, by_role: bool = True) -> DataFrame:
    """Rows that pass every filter given. actor is a kind of actor, or with by_role a role; a row without a time passes
    no time filter; with refs, rows need an available one. Chunks are filtered without roles."""
    for column, value in (("session_id", session), ("kind", kind), ("status", status)):
        if value:
            rows = rows.where(F.coalesce(F.col(column), F.lit("")) == value)
    if actor:
        rows = rows.where(F.coalesce(F.col("actor_kind") == actor, F.lit(False)) | (F.coalesce(F.col("actor_role") == actor, F.lit(False)) if by_role else F.lit(False)))
    for value, label, keep in ((since, "from", lambda c, v: c >= v), (until, "to", lambda c, v: c <= v)):
        if value:
            rows = rows.where(keep(F.col("observed_at"), F.lit(time_filter(value, label))))
    if refs is not None:
        rows = rows.join(refs.where("availability is null or availability = 'AVAILABLE'").select("event_id").distinct(), "event_id", "left_semi")
    return rows


def hybrid(lexical: DataFrame, semantic: DataFrame, graph: DataFrame | None, limit: int, key: str = "event_id") -> DataFrame:
    """Fused (key, rank) lists with what a graph adds to candidates and brings in itself, graph(key, contribution): the
    `limit` best by score, then key."""
    part = lambda c: F.coalesce(1 / (RRF + F.col(c)), F.lit(0.0))
    rows = lexical.select(key, F.col("rank").alias("lexical_rank")).join(semantic.select(key, F.col("rank").alias("semantic_rank")), key, "full")
    score = part("lexical_rank") + part("semantic_rank")
    if graph is not None:
        rows = rows.join(graph.select(key, "contribution"), key, "full")
        score = score + F.coalesce("contribution", F.lit(0.0))
    return rows.withColumn("score", score).orderBy(F.desc("score"), key).limit(limit)


def dispatch(mode: str, lexical=None, semantic=None, fused=None) -> tuple[str, DataFrame | None]:
    """The mode that takes effect and its rows, from functions that give them. Semantic or hybrid search without a
    projection is UNAVAILABLE, never another mode."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    needed = {"lexical": lexical, "semantic": semantic, "hybrid": fused if semantic else None}[mode]
    return (mode, needed()) if needed else ("UNAVAILABLE", None)


def assessed(results: Column, failures: Column, gaps: Column) -> Column:
    """The state of an answer from its numbers of results, of results whose evidence fails, and of known gaps."""
    return F.when((results > 0) & (failures == 0), "VERIFIED_PRESENT").when((results > 0) | (gaps > 0), "INCONCLUSIVE_COVERAGE").otherwise("NOT_OBSERVED_IN_CAPTURED_EVIDENCE")


def evidence_failures(results: DataFrame, refs: DataFrame, records: DataFrame) -> DataFrame:
    """n_results, n_failures: results(event_id) without an available address whose record is held with its hash."""
    good = refs.where("availability = 'AVAILABLE'").join(records.select("source", "ordinal", "line"), ["source", "ordinal"]).where(F.sha2("line", 256) == F.col("sha256")).select("event_id").distinct()
    rows = results.select("event_id").join(good.withColumn("__ok", F.lit(True)), "event_id", "left")
    return rows.agg(F.count("*").alias("n_results"), F.count_if(F.col("__ok").isNull()).alias("n_failures"))


def read_evidence(refs: DataFrame, records: DataFrame, uri: str) -> DataFrame:
    """text, verified of the bytes that a registered address names; no rows for one that isn't registered. A record
    whose hash disagrees is not shown."""
    ref = refs.where(F.col("uri") == uri).withColumn("a", reading.address(F.col("uri")))
    rows = ref.join(records.select("source", "ordinal", "line"), ["source", "ordinal"], "left")
    ok = F.coalesce(F.sha2("line", 256) == F.col("sha256"), F.lit(False))
    return rows.select(ok.alias("verified"), F.when(ok, F.col("line")).alias("text"), "a.offset", "a.length")


def receipt(results: DataFrame, query: str, case_hash: str, mode: str, key: str = "event_id") -> DataFrame:
    """One row: digests of the query and of the ordered results with their addresses (uris)."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", key, "uris"))), lambda r: F.to_json(F.struct(r[key].alias("id"), r["uris"].alias("evidence"))))
    return results.agg(F.lit(mode).alias("mode"), F.lit(case_hash).alias("case_hash"), sha256(F.lit(query)).alias("query_sha256"), F.count("*").alias("results"), F.sha2(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")), 256).alias("result_set_sha256"))


def recall(found: DataFrame, wanted: DataFrame, at: int) -> DataFrame:
    """found(query, marker, rank) against wanted(query, marker): the share of markers within the first `at`, and the
    mean of their first ranks."""
    first = found.where(F.col("rank") <= at).groupBy("query", "marker").agg(F.min("rank").alias("rank"))
    rows = wanted.join(first, ["query", "marker"], "left")
    return rows.agg(F.avg(F.col("rank").isNotNull().cast("double")).alias("recall"), F.avg("rank").alias("mean_rank"))
