"""What the corpus operators share: stage tables, Arrow batch mapping, exchanges of packed records, connected
components and joins inside groups of any size."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselake.staging import remove, scratch, shared_folder, stage

PART_BYTES, FLUSH_BYTES, ARROW_ROWS = 32 << 20, 16 << 20, 512


__all__ = ["remove", "scratch", "shared_folder", "stage"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = 256) -> DataFrame:
    """mapInArrow whose batches hold at most `rows` rows, so that long texts stay within a worker's memory; the session's
    batches, unless they are set otherwise, are bounded for the same reason."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    return df.mapInArrow(lambda batches: fn(run(batches)), schema)


def placed(df: DataFrame, file_col: str = "__file", place_col: str = "__place") -> DataFrame:
    """df and where each row stands in its Parquet files, which tells rows apart whatever they hold and is the same in
    every scan. What isn't read straight from Parquet is staged first."""
    where = (F.xxhash64("_metadata.file_path").alias(file_col), F.col("_metadata.row_index").alias(place_col))
    try:
        return df.select("*", *where)
    except AnalysisException:
        return stage(df, "rows", keep=True).select("*", *where)


def parts_for(df: DataFrame, growth: float) -> int:
    """Partitions for an exchange that carries about `growth` times df's bytes: as many as the session's shuffles have,
    or more, so that one has PART_BYTES at most."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    asked = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(asked, int(size * growth / PART_BYTES) if size < 1 << 60 else 0)


class Dealer:
    """Collects records whose first field is an unsigned 64-bit `key` and deals them to partitions by its upper bits.

    Blobs of one partition's records leave as rows (part, kind, blob). A key of which one flush holds more than half a
    partition's share is hot: its records go out as kind `hot` to partitions at random, and the key alone as kind `sign`
    to its own partition, for the key's records of other flushes.
    """

    def __init__(self, kind: int, dtype: np.dtype, parts: int, hot: int | None = None, sign: int | None = None):
        self.kind, self.dtype, self.parts, self.hot, self.sign = kind, dtype, parts, hot, sign
        self.held: list[np.ndarray] = []
        self.size = 0
        self.edges = np.array([-(-(p << 32) // parts) << 32 for p in range(1, parts)] if parts > 1 << 16 else [], np.uint64)
        self.turn = uuid.uuid4().int % parts

    def add(self, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(records)
        self.size += records.nbytes
        if self.size > FLUSH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        self.held, self.size = [], 0
        if not len(rows):
            return
        out, most = [], max(4096, len(rows) // (2 * self.parts))
        if self.hot is not None and np.bincount((rows["key"] >> np.uint64(48)).astype(np.int64), minlength=1 << 16).max() > most:
            keys, count = np.unique(rows["key"], return_counts=True)
            over = keys[count > most]
            if len(over):
                much = np.isin(rows["key"], over)
                out += self._cut(self.sign, np.array(over, [("key", "<u8")]))
                spare, rows = rows[much], rows[~much]
                for at in range(0, len(spare), most):
                    self.turn = (self.turn + 1) % self.parts
                    out.append((self.turn, self.hot, spare[at : at + most]))
        out += self._cut(self.kind, rows)
        for at in range(0, len(out), 16):
            some = out[at : at + 16]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _, _ in some], pa.int32()), pa.array([k for _, k, _ in some], pa.int32()), pa.array([r.tobytes() for _, _, r in some], pa.binary())], ["part", "kind", "blob"]
            )


    def _cut(self, kind: int, rows: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        part = np.searchsorted(self.edges, rows["key"], side="right") if self.parts > 1 << 16 else ((rows["key"] >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        rows, count = rows[order], np.bincount(part, minlength=self.parts)
        end = np.cumsum(count)
        return [(p, kind, rows[end[p] - count[p] : end[p]]) for p in np.flatnonzero(count).tolist()]


BLOBS = "part int, kind int, blob binary"


def exchanged(blobs: DataFrame, parts: int) -> DataFrame:
    """rows (part, kind, blob), each in the partition of its number."""
    return blobs.repartitionById(parts, F.col("part"))


def gathered(batches: Iterator[pa.RecordBatch], dtypes: dict[int, np.dtype]) -> dict[int, np.ndarray]:
    """All records of a partition by kind."""
    held: dict[int, list[bytes]] = {k: [] for k in dtypes}
    for b in batches:
        for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob").to_pylist(), strict=True):
            held[kind].append(blob)
    out = {}
    for kind in list(held):
        out[kind] = np.frombuffer(b"".join(held.pop(kind)), dtypes[kind])
    return out


def components(links: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of links(a long, b long): returns (id, component) with the smallest id as component.

    Alternating large-star and small-star rounds; each is one aggregation by vertex, the vertices with many
    neighbours are aggregated with partial sums (min), and the number of rounds grows with the logarithm of the
    diameter. Only a count of changes reaches the driver. Each round's table replaces the one before it.
    """
    spark = links.sparkSession
    with scratch(spark):
        edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
        for _ in range(rounds if not edges.isEmpty() else 0):
            both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
            low2 = down.groupBy("u").agg(F.min("v").alias("m"))
            small = down.join(low2.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            new = stage(small.union(low2.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
            ends = new.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(new.select("v", F.lit(0), F.lit(1)))
            done = not ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").limit(1).count()
            edges = new
            if done:
                break
        else:
            if not edges.isEmpty():
                raise RuntimeError("connected components did not converge")
        roots = edges.select(F.col("v").alias("id")).distinct()
        return stage(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component"))), name, keep=True)


LINKS = "a long, b long"
#: Finds links among the rows of one table: (rows, their groups or None, which side of a pair of blocks or None).
Linker = Callable[[pa.Table, list[int] | None, list[bool] | None], list[tuple[int, int]]]
#: Finds the links of one of the rows, by its number, with the others.
Star = Callable[[pa.Table, int], list[tuple[int, int]]]


def as_links(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def classes_of(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(id, smallest id connected with it) of all ends of links."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(parent)]


def classes_within(rows: DataFrame, link: Linker) -> DataFrame:
    """rows(component, id, ...) -> id, component of the classes that links make inside each component, which one task
    can hold; a task takes its components one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def found(t: pa.Table) -> pa.RecordBatch:
            edge = np.flatnonzero(np.diff(t.column("component").to_numpy())) + 1
            cut = [0, *edge.tolist(), t.num_rows]
            out = classes_of([x for a, b in zip(cut[:-1], cut[1:], strict=True) if b - a > 1 for x in link(t.slice(a, b - a), None, None)])
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["id", "component"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            component = t.column("component").to_numpy()
            cut = int(np.searchsorted(component, component[-1]))
            if cut:
                yield found(t.slice(0, cut).combine_chunks())
            held = t.slice(cut)
        if held is not None:
            yield found(held.combine_chunks())

    return rows.repartition("component").sortWithinPartitions("component", "id").mapInArrow(run, "id long, component long")


def links_by_key(keyed: DataFrame, rows: DataFrame, star: Star, link: Linker, block: int, name: str) -> DataFrame:
    """Links among rows(id, ...) that share a key, keyed(id, key), for groups that no task could hold.

    Round 1 compares each key's ids with its smallest one, in blocks that have a copy of it: a number of rows in
    proportion to the keys, after which the members of most groups of near copies are connected. Round 2 compares the
    rest: a key whose members are all connected is done, keys with the same members are looked at once, and of the
    others a group beyond `block` rows goes as pairs of blocks, inside which pairs that are connected are passed over.
    """
    keyed = stage(keyed.select("id", "key").distinct(), f"{name}-keys")
    least = keyed.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("k")).where("k > 1").drop("k")
    stars = stage(keyed.join(least.hint("merge"), "key").where("id <> least").select("least", "id").distinct(), f"{name}-stars")
    sizes = stage(stars.groupBy("least").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), f"{name}-sizes")
    members = stars.join(sizes.hint("merge"), "least").select("least", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "id")
    heads = sizes.select("least", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("least").alias("id"))

    def first(t: pa.Table) -> pa.Table:
        return as_links(star(t, t.column("id").to_pylist().index(t.column("least")[0].as_py())))

    near = stage(members.union(heads).join(rows.hint("merge"), "id").groupBy("least", "block").applyInArrow(first, LINKS), f"{name}-near")
    known = keyed.join(components(near, f"{name}-near").hint("merge"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("group"))
    unsettled = known.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("id")).alias("same"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("same2"))
    unsettled = stage(unsettled.where("low <> high").groupBy("same", "same2", "k").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("k") / block).cast("int").alias("blocks")), f"{name}-open")
    open_rows = known.join(unsettled.hint("merge"), "key").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    open_rows = open_rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "group", "id")

    def second(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        return as_links(link(t, t.column("group").to_pylist(), None if i == j else [o == i for o in t.column("own").to_pylist()]))

    rest = stage(open_rows.join(rows.hint("merge"), "id").groupBy("key", "i", "j").applyInArrow(second, LINKS), f"{name}-rest")
    return near.union(rest)
