"""Fixity audit of replicated WARC archives by Merkle trees over ordered offset ranges.

A record's leaf is the digest of its bytes. Leaves are put into trees by where they lie: level 0 has one node for each
RANGE bytes of an archive (the records that begin there, in order of offset), and each higher level joins FAN ranges,
up to the archive's root. Node digests are over (offset or range, digest) of their children in order; a node has at
most RANGE records or FAN children, so no group grows with the data. Two replicas are compared root by root; only
children of mismatching nodes are joined on the next level, down to the records, which are told missing, extra or
corrupt. Levels are kept as staged tables of digests.

Records are matched by archive and offset. Defined cases: null url and html are empty; a record with a null id is
left out of no archive, its id counts as -1; rows that repeat an id give records at
different offsets, in order of their digests; empty tables give empty audits;
an archive that one replica lacks is reported by its root and all its records. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, stage

ARCHIVE, RANGE, FAN, LEVELS, SLOTS = 500, 65536, 16, 3, 4096


def warc_record(url: Column, body: Column) -> Column:
    """A WARC/1.0 response record as text; the length counts the body's UTF-8 bytes."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", per_archive: int = ARCHIVE, also: tuple[str, ...] = ()) -> DataFrame:
    """archive, offset, length, record_id, leaf and the columns `also`: pages laid out in archives of `per_archive`
    consecutive ids. Those without an id are archive -1, which may be large: its records lie by hash, and each hash's
    place is the sum of what the hashes before it hold."""
    rid = F.coalesce(F.col(id_col).cast("long"), F.lit(-1))
    made = pages.select(rid.alias("record_id"), F.col(id_col).isNull().alias("none"), warc_record(F.col(url_col), F.col(body_col)).alias("r"), *also)
    made = made.select("record_id", "none", F.octet_length("r").cast("long").alias("length"), F.sha2(F.encode("r", "UTF-8"), 256).alias("leaf"), *also)
    made = made.withColumn("archive", F.floor(F.col("record_id") / per_archive).cast("long"))
    made = made.withColumn("slot", F.when(F.col("none"), F.pmod(F.xxhash64("leaf"), F.lit(SLOTS))).otherwise(F.lit(-1)))
    before = Window.partitionBy("archive", "slot").orderBy("record_id", "leaf").rowsBetween(Window.unboundedPreceding, -1)
    made = made.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    held = made.where("none").groupBy("archive", "slot").agg(F.sum("length").alias("held"))  # SLOTS rows at most
    base = held.select("archive", "slot", F.coalesce(F.sum("held").over(Window.partitionBy("archive").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = made.join(base.hint("merge"), ["archive", "slot"], "left")
    return placed.select("archive", (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"), "length", "record_id", "leaf", *also)


def tree(leaves: DataFrame, size: int = RANGE, fan: int = FAN, levels: int = LEVELS) -> list[DataFrame]:
    """Nodes (archive, node, digest) of each level, level 0 first; the last level has one node an archive."""
    nodes = leaves.select("archive", F.floor(F.col("offset") / size).cast("long").alias("node"), F.col("offset").alias("k"), F.col("leaf").alias("digest"))
    out = []
    for level in range(levels + 1):
        parts = F.transform(F.sort_array(F.collect_list(F.struct("k", "digest"))), lambda c: F.concat(c["k"].cast("string"), F.lit(":"), c["digest"]))
        out.append(stage(nodes.groupBy("archive", "node").agg(F.sha2(F.array_join(parts, ";"), 256).alias("digest")), f"merkle-{level}"))
        up = F.lit(0).cast("long") if level == levels - 1 else F.floor(F.col("node") / fan).cast("long")
        nodes = out[-1].select("archive", up.alias("node"), F.col("node").alias("k"), "digest")
    return out


def mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    joined = a.withColumnRenamed("digest", "da").join(b.withColumnRenamed("digest", "db").hint("merge"), ["archive", "node"], "full")
    return joined.where(~F.col("da").eqNullSafe(F.col("db"))).select("archive", "node")


def audit(good: DataFrame, other: DataFrame, size: int = RANGE, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """Replicas of records (archive, offset, length, record_id, leaf) -> one row an archive and one a faulty record:
    archive, kind (root or record), status, offset, length, record_id (these three -1 for roots), digest_a, digest_b."""
    trees = tree(good, size, fan, levels), tree(other, size, fan, levels)
    a, b = (t[-1].select("archive", F.col("digest").alias(d)) for t, d in zip(trees, ("digest_a", "digest_b"), strict=True))
    roots = stage(a.join(b.hint("merge"), "archive", "full"), "roots")
    suspect = roots.where(~F.col("digest_a").eqNullSafe(F.col("digest_b"))).select("archive", F.lit(0).cast("long").alias("node"))
    for level in range(levels - 1, -1, -1):
        up = F.lit(0).cast("long") if level == levels - 1 else F.floor(F.col("node") / fan).cast("long")
        below = [t[level].withColumn("up", up).join(suspect.select("archive", F.col("node").alias("up")), ["archive", "up"], "left_semi").drop("up") for t in trees]
        suspect = stage(mismatches(*below), "suspect")
    picked = [leaves.withColumn("node", F.floor(F.col("offset") / size).cast("long")).join(suspect, ["archive", "node"], "left_semi").drop("node") for leaves in (good, other)]
    x, y = (p.select("archive", "offset", F.struct("length", "record_id", "leaf").alias(n)) for p, n in zip(picked, "xy", strict=True))
    faults = x.join(y.hint("merge"), ["archive", "offset"], "full").where(~F.col("x.leaf").eqNullSafe(F.col("y.leaf")))
    status = F.when(F.col("x").isNull(), "extra").when(F.col("y").isNull(), "missing").otherwise("corrupt")
    faults = faults.select("archive", F.lit("record").alias("kind"), status.alias("status"), "offset", F.coalesce("x.length", "y.length").alias("length"), F.coalesce("x.record_id", "y.record_id").alias("record_id"), F.col("x.leaf").alias("digest_a"), F.col("y.leaf").alias("digest_b"))
    status = F.when(F.col("digest_a").isNull(), "extra").when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a") == F.col("digest_b"), "intact").otherwise("differs")
    none = F.lit(-1).cast("long")
    return roots.select("archive", F.lit("root").alias("kind"), status.alias("status"), none.alias("offset"), none.alias("length"), none.alias("record_id"), "digest_a", "digest_b").unionByName(faults)


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a simulated replica of all pages, in which every 97th has its letters e turned round and every 211th is
    gone: its records keep the offsets of the original, lost ones leave a gap."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    k = F.coalesce(F.col("page_id"), F.lit(0))
    other = warc_record(F.col("url"), F.when(k % 97 == 13, F.translate("html", "e", "E")).otherwise(F.col("html")))
    pages = pages.select("*", (k % 211 != 5).alias("held"), F.octet_length(other).cast("long").alias("other_length"), F.sha2(F.encode(other, "UTF-8"), 256).alias("other_leaf"))
    with scratch(spark):
        both = stage(records(pages, also=("held", "other_length", "other_leaf")), "replicas")
        good = both.select("archive", "offset", "length", "record_id", "leaf")
        replica = both.where("held").select("archive", "offset", F.col("other_length").alias("length"), "record_id", F.col("other_leaf").alias("leaf"))
        return stage(audit(good, replica), "fixity", keep=True)


ORACLE = f"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS a, CASE WHEN page_id % 97 = 13 THEN replace(coalesce(html, ''), 'e', 'E') ELSE coalesce(html, '') END AS b,
         page_id % 211 <> 5 AS held FROM pages),
r AS (
  SELECT page_id, page_id // {ARCHIVE} AS archive, held,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(a) || chr(13) || chr(10) || chr(13) || chr(10) || a || chr(13) || chr(10) || chr(13) || chr(10) AS ra,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(b) || chr(13) || chr(10) || chr(13) || chr(10) || b || chr(13) || chr(10) || chr(13) || chr(10) AS rb FROM p),
l AS (
  SELECT archive, page_id, strlen(ra) AS length, sha256(ra) AS da, CASE WHEN held THEN sha256(rb) END AS db,
         coalesce(sum(strlen(ra)) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM r),
n0 AS (
  SELECT archive, o // {RANGE} AS node, sha256(string_agg(o || ':' || da, ';' ORDER BY o)) AS da, sha256(string_agg(o || ':' || db, ';' ORDER BY o) FILTER (db IS NOT NULL)) AS db FROM l GROUP BY ALL),
n1 AS (
  SELECT archive, node // {FAN} AS node, sha256(string_agg(node || ':' || da, ';' ORDER BY node)) AS da, sha256(string_agg(node || ':' || db, ';' ORDER BY node) FILTER (db IS NOT NULL)) AS db FROM n0 GROUP BY archive, n0.node // {FAN}),
n2 AS (
  SELECT archive, node // {FAN} AS node, sha256(string_agg(node || ':' || da, ';' ORDER BY node)) AS da, sha256(string_agg(node || ':' || db, ';' ORDER BY node) FILTER (db IS NOT NULL)) AS db FROM n1 GROUP BY archive, n1.node // {FAN}),
n3 AS (
  SELECT archive, sha256(string_agg(node || ':' || da, ';' ORDER BY node)) AS da, sha256(string_agg(node || ':' || db, ';' ORDER BY node) FILTER (db IS NOT NULL)) AS db FROM n2 GROUP BY archive)
SELECT archive, 'root' AS kind, CASE WHEN db IS NULL THEN 'missing' WHEN da = db THEN 'intact' ELSE 'differs' END AS status,
       (-1)::BIGINT AS "offset", (-1)::BIGINT AS length, (-1)::BIGINT AS record_id, da AS digest_a, db AS digest_b FROM n3
UNION ALL
SELECT archive, 'record', CASE WHEN db IS NULL THEN 'missing' ELSE 'corrupt' END, o, length, page_id, da, db FROM l WHERE da IS DISTINCT FROM db
"""
