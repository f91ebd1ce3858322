"""Removes every byte that lies in a string of WIDTH bytes occurring elsewhere in the corpus.

Only windows (suffixes cut at WIDTH bytes) that can repeat are sorted, one suffix bucket at a time:

1. A window's bucket is the hash of its least K-byte gram (leftmost of equal ones), so equal windows share bucket and
   offset from that gram. One scan lists, for each such gram of a document, bucket, the run of window starts it stands
   for, and a digest of that run's bytes (a context).
2. A bucket with one context occurring once has nothing. Counts by bucket and digest are a filter before the sort:
   equal contexts repeat in whole. What is left are buckets of several different contexts, and one occurrence of each is
   fetched from its document. A bucket beyond BLOCK bytes is split by the bytes around its gram: into slices of windows
   with the gram at neighbouring offsets, whose common bytes name the new bucket; a slice that is still too large has
   windows that differ in a few bytes at their ends, and these windows are counted.
3. Buckets go to tasks by hash and are sorted in blocks of at most BLOCK bytes. Ranks of the positions in a difference
   cover modulo V are computed first, by doubling, for strings of 4 V bytes. Suffixes are sorted by bucket and first V
   bytes, ties by the rank of the next cover position and then by the last V bytes of the window. Contexts are laid out
   with their gram at a multiple of V, so that windows that may be equal meet the cover at the same offset. Neighbours
   that agree in all are equal windows.
4. The repeated runs go back to all occurrences of their context, and each document drops what they cover.

Memory: a block's bytes, the ranks of its cover positions and the keys of its suffixes. Nothing is collected.

Defined cases: null text is empty; documents of fewer than WIDTH bytes lose nothing; copies of a document of WIDTH
bytes or more lose everything; matches overlap freely and never cross documents; rows are told apart by their place, so
repeated rows are copies of each other, and null ids are handled like others. Other columns pass through
unread or, in `clean`, unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOBS, Dealer, exchanged, gathered, map_arrow, parts_for, placed, scratch, stage
from .shingles import BASE, DOWN, INVERSE, UP, mix, powers

WIDTH, K, V, BLOCK, SLAB, SLICE = 200, 80, 40, 4_000_000, 1 << 20, 15
#: Kinds of records: contexts; those of buckets that are hot, and their signs.
CTX_ROW, CTX_HOT, CTX_SIGN = range(3)
CTX = np.dtype([("key", "<u8"), ("digest", "<u8"), ("file", "<i8"), ("place", "<i8"), ("first", "<i4"), ("span", "<i4"), ("at", "<i4")])
_BYTE = np.random.default_rng(20240301).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def difference_cover(v: int) -> list[int]:
    """A small set of residues whose differences modulo v take every value."""
    cover, seen = [0], {0}
    while len(seen) < v:
        gain = {x: len(({(x - c) % v for c in cover} | {(c - x) % v for c in cover}) - seen) for x in range(v) if x not in cover}
        best = max(gain, key=lambda x: (gain[x], -x))
        seen |= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
        cover.append(best)
    return sorted(cover)


class Grams:
    """Rolling hashes of a text's bytes and the least gram of each window."""

    def __init__(self):
        self.up, self.down = UP, DOWN

    def contexts(self, raw: bytes) -> np.ndarray:
        """Records of CTX, one a gram, without the row's place; SLAB windows at a time, so that memory doesn't grow with
        the text (a run cut there is two contexts, which the sort brings together)."""
        out = [np.zeros(0, CTX)]
        for at in range(0, max(0, len(raw) - WIDTH + 1), SLAB):
            bucket, digest, first, span, gram = self._contexts(raw[at : at + SLAB + WIDTH - 1])
            made = np.zeros(len(bucket), CTX)
            made["key"], made["digest"], made["first"], made["span"], made["at"] = bucket.view(np.uint64), digest.view(np.uint64), first + at, span, gram
            out.append(made)
        return np.concatenate(out)

    def _contexts(self, raw: bytes) -> tuple[np.ndarray, ...]:
        """bucket, digest, first window, number of windows, offset of the gram from the first window; one a gram."""
        n, w = len(raw) - WIDTH + 1, WIDTH - K + 1
        if n <= 0:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int32))
        if len(raw) > len(self.up):
            self.up, self.down = powers(len(raw), BASE), powers(len(raw), INVERSE)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[np.frombuffer(raw, np.uint8)] * self.up[: len(raw)], out=sums[1:])
        m = len(raw) - K + 1
        gram = mix((sums[K:] - sums[:m]) * self.down[:m])
        least = self._least(gram, w)[:n]
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        span = np.diff(np.append(first, n))
        end = first + span - 1 + WIDTH
        digest = mix((sums[end] - sums[first]) * self.down[first] + span.astype(np.uint64))
        at = least[first]
        return mix(gram[at]).view(np.int64), digest.view(np.int64), first.astype(np.int32), span.astype(np.int32), (at - first).astype(np.int32)

    @staticmethod
    def _least(gram: np.ndarray, w: int) -> np.ndarray:
        """Position of the leftmost least gram in each run of w."""
        m, bits = len(gram), max(1, int(len(gram)).bit_length())
        key = gram >> np.uint64(bits) << np.uint64(bits) | np.arange(m, dtype=np.uint64)
        blocks = -(-m // w)
        grid = np.full(blocks * w, np.iinfo(np.uint64).max)
        grid[:m] = key
        grid = grid.reshape(blocks, w)
        ahead = np.minimum.accumulate(grid, 1).reshape(-1)
        behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
        k = m - w + 1
        return (np.minimum(behind[:k], ahead[w - 1 : w - 1 + k]) & np.uint64((1 << bits) - 1)).astype(np.int64)


def words_at(text: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The V bytes from each position as big-endian 64-bit words, which sort as the bytes do."""
    out = []
    for j in range(0, V, 8):
        word = np.zeros(len(at), np.uint64)
        for b in range(8):
            word = word << np.uint64(8) | text[at + (j + b)].astype(np.uint64)
        out.append(word)
    return out


def dense(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks from 0 by the keys, the first most significant; equal keys share a rank."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def repeated_windows(bucket: np.ndarray, contexts: list[bytes], at: np.ndarray) -> list[np.ndarray]:
    """contexts: different ones; at: offset of each one's gram. Returns for each the flags of windows that occur in
    another context of its bucket."""
    size = np.array([len(c) for c in contexts])
    span = size - WIDTH + 1
    base, end = np.zeros(len(contexts), np.int64), 0
    for i in range(len(contexts)):
        base[i] = end + (-(end + int(at[i]))) % V
        end = int(base[i]) + int(size[i])
    text = np.zeros(end + 5 * V, np.uint8)
    for b, c in zip(base.tolist(), contexts, strict=True):
        text[b : b + len(c)] = np.frombuffer(c, np.uint8)

    cover = np.array(difference_cover(V))
    rows = np.arange(0, end + V, V)
    sample = (rows[:, None] + cover[None, :]).reshape(-1)
    sample = sample[sample + V <= len(text)]
    place = np.full(len(text) + 4 * V, -1, np.int64)
    place[sample] = np.arange(len(sample))
    rank = dense(words_at(text, sample))
    for step in (V, 2 * V):
        after = place[sample + step]
        rank = dense([rank, np.where(after >= 0, rank[after], -1)])

    owner = np.repeat(np.arange(len(contexts)), span)
    start = base[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(span) - span, span)
    residue = start % V
    gap = np.array([min((c - r) % V for c in cover) for r in range(V)])
    keys = [bucket[owner], *words_at(text, start), residue, rank[place[start + gap[residue]]], *words_at(text, start + WIDTH - V)]
    order = np.lexsort(keys[::-1])
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        s = k[order]
        same &= s[1:] == s[:-1]
    flag = np.zeros(len(order), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return np.split(flag, np.cumsum(span)[:-1])


def runs(flags: np.ndarray) -> list[int]:
    """Begins and ends of the runs of True, in turn."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.tolist()


def contexts_of(docs: DataFrame) -> DataFrame:
    """docs(file, place, text) -> file, place, bucket, digest, first, span, at of the contexts whose bucket is not
    theirs alone. They travel as packed records, and most of them end where they meet no other."""
    parts = parts_for(docs, 2.0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, out = Grams(), Dealer(CTX_ROW, CTX, parts, CTX_HOT, CTX_SIGN)
        for b in batches:
            for file, place, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                made = grams.contexts(t.encode())
                made["file"], made["place"] = file, place
                yield from out.add(made)
        yield from out.flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gathered(batches, {CTX_ROW: CTX, CTX_HOT: CTX, CTX_SIGN: np.dtype([("key", "<u8")])})
        rows = got[CTX_ROW]
        rows = rows[np.argsort(rows["key"], kind="stable")]
        same = np.zeros(len(rows) + 1, bool)
        same[1:-1] = rows["key"][1:] == rows["key"][:-1]
        for some in (rows[same[1:] | same[:-1] | np.isin(rows["key"], got[CTX_SIGN]["key"])], got[CTX_HOT]):
            for at in range(0, len(some), 100_000):
                x = some[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(x[n].copy() if n not in ("key", "digest") else x[n].copy().view(np.int64)) for n in ("file", "place", "key", "digest", "first", "span", "at")], ["file", "place", "bucket", "digest", "first", "span", "at"])

    return exchanged(map_arrow(docs, scan, BLOBS), parts).mapInArrow(meet, "file long, place long, bucket long, digest long, first int, span int, at int")


def fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(file, place, bucket, digest, first, span, at) -> bucket, digest, at, context, by way of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, need in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = text.encode()
                out += [(w["bucket"], w["digest"], w["at"], raw[w["first"] : w["first"] + w["span"] + WIDTH - 1]) for w in need]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], ["bucket", "digest", "at", "context"])

    lists = wanted.groupBy("file", "place").agg(F.collect_list(F.struct("bucket", "digest", "first", "span", "at")).alias("need"))
    return map_arrow(docs.join(lists.hint("shuffle_hash"), ["file", "place"]).select("text", "need"), run, "bucket long, digest long, at int, context binary", rows=64)


def sort_buckets(contexts: DataFrame) -> DataFrame:
    """bucket, digest, at, context -> bucket, digest, runs array<int> of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def block(rows: list[tuple]) -> pa.RecordBatch:
            flags = repeated_windows(np.array([r[0] for r in rows]), [r[3] for r in rows], np.array([r[2] for r in rows]))
            out = [(r[0], r[1], runs(f)) for r, f in zip(rows, flags, strict=True) if f.any()]
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int32()))], ["bucket", "digest", "runs"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size > BLOCK and held[-1][0] != row[0]:
                    yield block(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield block(held)

    dealt = contexts.repartition("bucket").sortWithinPartitions("bucket", "digest")
    return dealt.mapInArrow(run, "bucket long, digest long, runs array<int>")


def sliced(contexts: DataFrame) -> DataFrame:
    """Contexts of buckets that no block holds, cut into those of windows with the gram at SLICE neighbouring offsets.
    Such windows have all but SLICE - 1 of their bytes in common if they may be equal, and these name the new bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for bucket, digest, at, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                span = len(raw) - WIDTH + 1
                for low in range(0, WIDTH - K + 1, SLICE):
                    first, last = max(0, at - low - SLICE + 1), min(span - 1, at - low)
                    if first <= last:
                        core = raw[at - low : at - low - SLICE + 1 + WIDTH]
                        part = raw[first : last + WIDTH]
                        out.append((bucket, digest, first, xxhash.xxh3_64_intdigest(core, low) >> 1, xxhash.xxh3_64_intdigest(part, at - first) >> 1, at - first, part))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["of_bucket", "of_digest", "shift", "bucket", "digest", "at", "context"])

    return map_arrow(contexts.select("bucket", "digest", "at", "context"), run, "of_bucket long, of_digest long, shift int, bucket long, digest long, at int, context binary")


def counted(contexts: DataFrame) -> DataFrame:
    """bucket, digest, runs of contexts whose windows are counted one by one, by 128-bit digests: slices whose windows
    differ in their last few bytes only and are still too many for a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(bucket, digest, k, xxhash.xxh3_128_digest(raw[k : k + WIDTH])) for bucket, digest, raw in zip(*(c.to_pylist() for c in b.columns), strict=True) for k in range(len(raw) - WIDTH + 1)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["bucket", "digest", "k", "window"])

    windows = stage(map_arrow(contexts.select("bucket", "digest", "context"), run, "bucket long, digest long, k int, window binary"), "windows")
    often = windows.groupBy("bucket", "window").agg(F.count("*").alias("n")).where("n > 1").select("bucket", "window")
    return windows.join(often.hint("merge"), ["bucket", "window"]).select("bucket", "digest", F.array("k", F.col("k") + 1).alias("runs"))


def large_buckets(contexts: DataFrame, name: str) -> DataFrame:
    return stage(contexts.groupBy("bucket").agg(F.sum(F.octet_length("context").cast("long")).alias("n")).where(F.col("n") > BLOCK).select("bucket"), name)


def repeated_runs(contexts: DataFrame) -> DataFrame:
    """Different contexts (bucket, digest, at, context) of the buckets -> bucket, digest, runs of windows that occur in
    another one; a context may have several rows."""
    large = large_buckets(contexts, "large-buckets")
    found = sort_buckets(contexts.join(large.hint("merge"), "bucket", "left_anti").select("bucket", "digest", "at", "context"))
    if large.isEmpty():
        return found
    cut = stage(sliced(contexts.join(large.hint("merge"), "bucket", "left_semi")), "slices")
    kinds = stage(cut.groupBy("bucket", "digest").agg(F.count("*").alias("n"), F.first("at").alias("at"), F.first("context").alias("context")), "slice-kinds")
    whole = kinds.where("n > 1").select("bucket", "digest", F.array(F.lit(0), F.octet_length("context") - (WIDTH - 1)).alias("runs"))
    over = large_buckets(kinds, "large-slices")
    some = sort_buckets(kinds.join(over.hint("merge"), "bucket", "left_anti").select("bucket", "digest", "at", "context"))
    some = some.union(counted(kinds.join(over.hint("merge"), "bucket", "left_semi")))
    back = cut.select("of_bucket", "of_digest", "shift", "bucket", "digest").join(stage(whole.union(some), "slice-runs").hint("merge"), ["bucket", "digest"])
    return found.union(back.select("of_bucket", "of_digest", F.transform("runs", lambda x: x + F.col("shift")).alias("runs")))


def repeats(docs: DataFrame) -> DataFrame:
    """docs(file, place, text) -> file, place, spans array<struct<first, runs>>: runs of repeated windows, from first."""
    made = stage(contexts_of(docs), "contexts")
    kinds = made.groupBy("bucket", "digest").agg(F.count("*").alias("k"), F.min(F.struct("file", "place", "first", "span", "at")).alias("one"))
    kinds = stage(kinds, "context-kinds")
    open_buckets = stage(kinds.groupBy("bucket").agg(F.count("*").alias("different")).where("different > 1").select("bucket"), "open-buckets")
    wanted = kinds.join(open_buckets.hint("merge"), "bucket", "left_semi").select("bucket", "digest", "one.*")
    runs = stage(repeated_runs(stage(fetch(docs, wanted), "open-contexts")), "runs")
    whole = kinds.where("k > 1").select("bucket", "digest", F.array(F.lit(0), F.col("one.span")).alias("runs"))
    partly = runs.join(whole.hint("merge"), ["bucket", "digest"], "left_anti")
    found = stage(whole.unionByName(partly), "repeated")
    joined = made.join(found.hint("merge"), ["bucket", "digest"]).select("file", "place", F.struct("first", "runs").alias("s"))
    return joined.groupBy("file", "place").agg(F.collect_list("s").alias("spans"))


def keep(raw: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """The bytes left, the number removed, the number of maximal runs removed."""
    cut = sorted((s["first"] + a, s["first"] + b - 1 + WIDTH) for s in spans for a, b in zip(s["runs"][::2], s["runs"][1::2], strict=True))
    merged: list[list[int]] = []
    for a, b in cut:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    left, at = [], 0
    for a, b in merged:
        left.append(raw[at:a])
        at = b
    left.append(raw[at:])
    return b"".join(left), sum(b - a for a, b in merged), len(merged)


def cut_out(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """df with __file and __place, and (file, place, spans) of the rows that lose bytes."""
    with scratch(df.sparkSession):
        rows = placed(df)
        docs = rows.select(F.col("__file").alias("file"), F.col("__place").alias("place"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        return rows, stage(repeats(docs), "spans", keep=True)


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    return rows.join(spans.hint("shuffle_hash"), (F.col("__file") == F.col("file")) & (F.col("__place") == F.col("place")), "left")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spans = cut_out(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = text.encode()
                left, removed, n = keep(raw, found or [])
                out.append((len(raw), removed, n, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = with_spans(rows, spans).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), "spans")
    return map_arrow(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", rows=64)


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the repeated bytes taken out of its texts; a character that loses bytes goes whole."""
    rows, spans = cut_out(df, id_col, text_col)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns[:-1])
            columns[at] = pa.array([t if s is None or t is None else keep(t.encode(), s)[0].decode("utf-8", "ignore") for t, s in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (rows.schema[c] for c in df.columns))
    return map_arrow(with_spans(rows, spans).select(*[F.col(f"`{c}`") for c in df.columns], F.col("spans").alias("__spans")), run, schema, rows=64)
