"""Checks of a stored case, each a row (check, ok, detail); what can't be read or found fails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselake.functions import reading

METRICS = ["sources", "sourceRecords", "parsedRecords", "unparsedRecords", "events", "tools", "artifacts", "decisions", "tasks", "validations", "warnings", "graphEdges"]  # fixed values


def finding(rows: DataFrame, check: str, wrong: Column, what: str) -> DataFrame:
    """One row: the check passes if no row is wrong."""
    n = F.count_if(F.coalesce(wrong, F.lit(True)))
    return rows.agg(n.alias("n")).select(F.lit(check).alias("check"), (F.col("n") == 0).alias("ok"), F.concat(F.col("n").cast("string"), F.lit(f" {what}")).alias("detail"))


def without(left: DataFrame, right: DataFrame, on: list[str], check: str, what: str) -> DataFrame:
    """Passes if every key of left is in right."""
    return finding(left.select(*on).join(right.select(*on).distinct(), on, "left_anti"), check, F.lit(True), what)


def records(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Lines as they are stored, (source, ordinal, line), against records(source, ordinal, sha256, byte_length)."""
    joined = expected.select("source", "ordinal", "sha256", "byte_length").join(stored.select("source", "ordinal", "line"), ["source", "ordinal"], "full")
    same = (F.sha2("line", 256) == F.col("sha256")) & (F.octet_length("line") == F.col("byte_length"))
    return finding(joined, "source.records", ~same, "record(s) whose bytes are missing or disagree")


def references(refs: DataFrame, record_rows: DataFrame) -> DataFrame:
    """refs(source, ordinal, sha256) must name records of that hash."""
    known = record_rows.select("source", "ordinal", F.col("sha256").alias("__sha"))
    return finding(refs.join(known, ["source", "ordinal"], "left"), "evidence.refs", F.col("__sha") != F.col("sha256"), "missing or hash-disagreeing reference(s)")


def coverage(record_rows: DataFrame, refs: DataFrame) -> DataFrame:
    return without(record_rows, refs, ["source", "ordinal"], "records.evidence_coverage", "source record(s) without an evidence reference")


def edge_ends(edges: DataFrame, nodes: DataFrame, check: str) -> DataFrame:
    """Every end of edges(src, dst) is one of nodes(node)."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return without(ends, nodes, ["node"], check, "edge end(s) without a node")


def edge_evidence(edges: DataFrame, refs: DataFrame) -> DataFrame:
    return without(edges.where("ref_id is not null"), refs, ["ref_id"], "graph.evidence", "edge(s) with an unknown reference")


def all_nodes(*tables: DataFrame) -> DataFrame:
    """node: the distinct ids of all tables, first column each."""
    return reduce(DataFrame.union, [t.select(F.col(t.columns[0]).alias("node")) for t in tables]).distinct()


def blobs(rows: DataFrame) -> DataFrame:
    """rows(sha256, byte_length, body binary): one storage each, length and hash as named."""
    return finding(rows, "blobs", ~((F.sha2("body", 256) == F.col("sha256")) & (F.octet_length("body") == F.col("byte_length"))), "blob(s) whose bytes are missing or disagree")


def metrics(counted: DataFrame, manifest: DataFrame) -> DataFrame:
    """counted(name, n) against the same of the manifest."""
    joined = manifest.where(F.col("name").isin(METRICS)).select("name", F.col("n").alias("__n")).join(counted, "name", "left")
    return finding(joined, "manifest.metrics", F.col("n") != F.col("__n"), "count(s) that disagree with the manifest")


def snapshot(sources: DataFrame, **config: str) -> DataFrame:
    """source_snapshot, case_hash: digests of the ordered sources (uri, harness, native_id, sha256, byte_length), and of
    that with the configuration."""
    row = reading.stable_json(harness=F.col("harness"), nativeId=F.col("native_id"), rawSha256=F.col("sha256"), byteLength=F.col("byte_length"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("uri", row.alias("j")))), lambda x: x["j"])
    out = sources.agg(F.sha2(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")), 256).alias("source_snapshot"))
    named = {k: F.lit(v) for k, v in config.items()}
    return out.withColumn("case_hash", F.sha2(reading.stable_json(sources=F.col("source_snapshot"), **named), 256))


def equal(actual: DataFrame, column: str, expected: str | None, check: str) -> DataFrame:
    """A digest against the one the manifest holds; one that it lacks disagrees."""
    return finding(actual, check, F.col(column) != F.lit(expected), "digest(s) that disagree with the manifest")


def complete(manifest: DataFrame) -> DataFrame:
    """manifest(status), one row at least."""
    return finding(manifest.agg(F.max("status").alias("status"), F.count("*").alias("n")), "manifest.complete", F.col("status") != "COMPLETE", "manifest(s) that are missing or not complete")


def projection(chunks: DataFrame, embeddings: DataFrame, dimensions: int) -> DataFrame:
    """chunks(chunk_id, content_sha256) and embeddings(content_sha256, vector): each chunk has its embedding, each
    embedding a chunk, and vectors are finite and of the right length."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    parts = [without(chunks, embeddings, ["content_sha256"], "projection.chunks", "chunk(s) without an embedding"), without(embeddings, chunks, ["content_sha256"], "projection.orphans", "embedding(s) without a chunk"),
             finding(embeddings, "projection.vectors", ~((F.size("vector") == dimensions) & finite), "vector(s) of a wrong form"),
             finding(embeddings.groupBy("content_sha256").count(), "projection.unique", F.col("count") > 1, "content hash(es) embedded twice")]
    return all_findings(*parts)


def all_findings(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def passed(findings: DataFrame) -> DataFrame:
    """passed, failed checks in order."""
    return findings.agg(F.bool_and("ok").alias("passed"), F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("check")))).alias("failed"))


def receipt(counts: dict[str, int], missing_artifacts: int = 0) -> dict[str, object]:
    """Readiness, confidence and anomalies of a case from its metrics."""
    n = lambda k: counts.get(k, 0) or 0
    said = [("unparsedRecords", "unparsed record(s)"), ("incompleteTools", "tool execution(s) without durable completion"), ("failedTools", "failed tool execution(s)"), ("missingArtifacts", "missing artifact(s)"), ("secretFindings", "secret-like projection(s) redacted"), ("contradictions", "reported-state contradiction(s)")]
    gaps = n("unparsedRecords") or n("incompleteTools") or n("contradictions") or missing_artifacts
    confidence = "UNCERTAIN (unparsed records exist)" if n("unparsedRecords") else "CORROBORATED within the observable boundary" if n("sources") else "UNAVAILABLE"
    return {"readiness": "READY_WITH_GAPS" if gaps else "READY", "confidence": confidence, "anomalies": [f"{n(k)} {text}" for k, text in said if n(k)]}
