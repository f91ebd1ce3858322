"""Packs tokenised documents into windows by minimum bin slack.

A document's ids are cut at multiples of the window; what is left of it is one shorter piece. Pieces are dealt by hash
into groups of about GROUP pieces, whose number grows with the input. In a group the longest piece left opens a
window, and subset-sum dynamic programming over a bitset of reachable fills (a Python integer, one bit a fill) picks
from the multiset of lengths left the counts that come closest to the capacity, found again by backtracking through
the bitsets before each step. Padding is left in a group's last windows mostly.

The model never joins what white space parts, so texts are cut into units there and each different unit is encoded
once a worker (UNITS of them at most are remembered): units are hashed in numpy, looked up in a table of hashes and
their ids gathered.

Defined cases: a null or empty text is the closing id alone, one piece of length 1. Rows that repeat an id are packed
as rows of their own. A row with a null id is packed like any other. Very long texts need memory in proportion to one
text. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, scratch, stage
from .shingles import _BYTE, BASE, DOWN, INVERSE, UP, mix, powers

WINDOW, END_ID, GROUP, UNITS, LONG = 4096, 2, 8192, 1 << 19, 64
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long"
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class WordBpe:
    """Ids of texts by a model whose words never cross white space.

    `slots` is an open-addressing table of unit hashes; a unit's ids are pool[start : start + count]. Units of more than
    LONG bytes, whose hashes could be made to meet, are told apart by their bytes instead.
    """

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        vocab = self.model.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.up, self.down = UP, DOWN
        self.clear(16)

    def clear(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self.slots, self.start, self.count = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        self.pool, self.filled = np.zeros(1 << bits, np.uint32), 0
        self.long: dict[bytes, int] = {}

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each hash's slot, and whether it is there already; else the slot is a free one."""
        mask = np.uint64((1 << self.bits) - 1)
        slot = hashes & mask
        seen = self.slots[slot]
        todo = np.flatnonzero((seen != hashes) & (seen != 0))
        while len(todo):
            slot[todo] = (slot[todo] + np.uint64(1)) & mask
            seen = self.slots[slot[todo]]
            todo = todo[(seen != hashes[todo]) & (seen != 0)]
        return slot.astype(np.int64), self.slots[slot] == hashes

    def put(self, hashes: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        """Different hashes that are not in the table yet."""
        if 2 * (self.used + len(hashes)) > len(self.slots):
            at = np.flatnonzero(self.slots)
            old = self.slots[at], self.start[at], self.count[at]
            while 2 * (self.used + len(hashes)) > 1 << self.bits:
                self.bits += 1
            self.slots, self.start, self.count = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, np.int64)
            self.used = 0
            self.put(*old)
        left = np.arange(len(hashes))
        while len(left):
            slot, _ = self.find(hashes[left])
            _, first = np.unique(slot, return_index=True)  # one a free slot, the others look again
            self.slots[slot[first]], self.start[slot[first]], self.count[slot[first]] = hashes[left[first]], start[left[first]], count[left[first]]
            left = np.delete(left, first)
        self.used += len(hashes)

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Starts in the pool and counts of the units' ids, which are added to it."""
        ids, count = [np.zeros(0, np.uint32)], np.zeros(len(units), np.int64)
        plain = [i for i, w in enumerate(units) if w.isalpha()]
        other = [i for i, w in enumerate(units) if not w.isalpha()]
        order = []
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            got = np.array(self.model.encode_batch_fast([" ".join(units[i] for i in part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[got]) + 1
            if len(ends) == len(part):  # each is a single word of the model, as letters alone are but for rare foldings
                count[part] = np.diff(ends, prepend=0)
                ids.append(got)
                order += part
            else:
                other += part
        for at in range(0, len(other), 20_000):
            part = other[at : at + 20_000]
            got = [e.ids for e in self.model.encode_batch_fast([units[i] for i in part], add_special_tokens=False)]
            count[part] = [len(x) for x in got]
            ids.append(np.array([t for x in got for t in x], np.uint32))
            order += part
        new = np.concatenate(ids)
        while self.filled + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.filled : self.filled + len(new)] = new
        start = np.zeros(len(units), np.int64)
        start[order] = self.filled + np.cumsum(count[order]) - count[order]
        self.filled += len(new)
        return start, count

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's followed by END_ID, and where each begins."""
        if self.used > UNITS or len(self.long) > UNITS // 16 or self.filled > 16 * UNITS:
            self.clear(16)
        raws = [(t or "").encode() for t in texts]
        raw = b" ".join([b"", *raws, b""])
        buf = np.frombuffer(raw, np.uint8)
        if len(buf) > len(self.up):
            self.up, self.down = powers(len(buf), BASE), powers(len(buf), INVERSE)
        solid = ~_GAP[buf]
        # a full stop or comma after an ASCII letter or digit and before white space is a word of its own
        cut = np.zeros(len(buf) + 1, bool)
        cut[1:-2] = _STOP[buf[1:-1]] & _PLAIN[buf[:-2]] & ~solid[2:]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | cut[1:-1]
        last[:-1] &= ~solid[1:] | cut[1:-1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * self.up[: len(buf)], out=sums[1:])
        size = end - begin
        hashes = mix((sums[end] - sums[begin]) * self.down[begin] + size.astype(np.uint64)) | np.uint64(1)
        for i in np.flatnonzero(size > LONG).tolist():
            hashes[i] = 2 * self.long.setdefault(raw[begin[i] : end[i]], len(self.long) + 1)  # even, so apart from the others
        slot, there = self.find(hashes)
        if not there.all():
            missing = np.flatnonzero(~there)
            new, at = np.unique(hashes[missing], return_index=True)
            at = missing[at]
            self.put(new, *self.encode_units([raw[a:b].decode() for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)]))
            slot, _ = self.find(hashes)
        start, count = self.start[slot], self.count[slot]
        starts = np.cumsum([1, *(len(r) + 1 for r in raws)])
        bounds = np.searchsorted(begin, starts)
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.repeat(start - ends[:-1], count) + np.arange(ends[-1])]
        text_ends = ends[bounds]
        return np.insert(ids, text_ends[1:], END_ID).astype("<u4"), text_ends + np.arange(len(text_ends))


@lru_cache(1)
def word_bpe(path: str | None) -> WordBpe:
    """One for all tasks that a worker runs, so that units are learned once."""
    return WordBpe(path)


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Each document's ids and its closing id, cut at multiples of the window; ids: unsigned 32-bit, little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for b in batches:
            ids, at = bpe.encode_all(b.column(1).to_pylist())
            size = np.diff(at)
            cuts = -(-size // window)
            doc = np.repeat(np.arange(len(size)), cuts)
            start = window * (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
            length = np.minimum(window, size[doc] - start)
            offsets = np.append(4 * (at[doc] + start), 4 * len(ids)).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), data, pa.array(size[doc])], ["doc_id", "start", "length", "ids", "doc_tokens"])

    return map_arrow(df.selectExpr(f"cast(`{id_col}` as long) id", f"`{text_col}` text"), run, PIECE)


def fill(lengths: dict[int, int], capacity: int) -> dict[int, int]:
    """The counts taken of a multiset of lengths so that their sum is as near to the capacity as can be, not above it."""
    mask, goal, reach, steps = (1 << capacity + 1) - 1, 1 << capacity, 1, []
    for length in sorted((x for x in lengths if x <= capacity), reverse=True):
        left, k = min(lengths[length], capacity // length), 1
        while left and not reach & goal:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << length * k & mask
            left, k = left - k, k * 2
        if reach & goal:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + k
            at -= length * k
    return taken


def windows(lengths: dict[int, int], capacity: int = WINDOW) -> Iterator[list[int]]:
    """Deals the whole multiset into windows: the longest left, then the best fill of the rest."""
    left = dict(lengths)
    while left:
        first = max(left)
        left[first] -= 1
        if not left[first]:
            del left[first]
        taken = fill(left, capacity - first) if first < capacity else {}
        out = [first]
        for length, k in taken.items():
            out += [length] * k
            left[length] -= k
            if not left[length]:
                del left[length]
        yield out


def pack(cut: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """pieces (doc_id, start, length and any other columns) -> the same with sequence_id and offset."""
    groups = -(-cut.count() // group) or 1

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        length = t.column("length").to_numpy()
        rows = {int(x): iter(np.flatnonzero(length == x).tolist()) for x in np.unique(length)}
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        base = t.column("__part")[0].as_py() << 32
        for k, lengths in enumerate(windows({int(x): int(n) for x, n in zip(*np.unique(length, return_counts=True), strict=True)}, window)):
            at = 0
            for x in lengths:
                r = next(rows[x])
                sequence[r], offset[r] = base + k, at
                at += x
        return t.drop_columns("__part").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    # the row's own number keeps rows that are alike in all columns from meeting in one group
    dealt = cut.withColumn("__part", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("__part").applyInArrow(run, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """packed pieces with their ids -> sequence_id, ids: the window's ids in order, padded with `pad` to its size."""

    def run(t: pa.Table) -> pa.Table:
        ids = b"".join(t.sort_by("offset").column("ids").to_pylist())
        ids += np.full(window - len(ids) // 4, pad, "<u4").tobytes()
        return pa.table({"sequence_id": t.column("sequence_id").slice(0, 1), "ids": pa.array([ids], pa.binary())})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(run, "sequence_id long, ids binary")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digests = made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    with scratch(spark):
        return pack(stage(digests, "pieces", keep=True))
