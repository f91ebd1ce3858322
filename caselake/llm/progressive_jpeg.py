"""Progressive JPEG images in numpy: lossless payload storage, and decoding to full-resolution RGB tensors.

`encode` stores a payload in the quantised coefficients of a 4:2:0 progressive image: 64 bytes are one block in zigzag
order, as signed bytes, with a quantisation table of ones. Each component has a DC scan, two AC bands by spectral
selection, and refinement scans by successive approximation; a restart interval of one block makes every block's bits
a lane of their own. `coefficients` reads progressive images of any scan script, Huffman tables, sampling and restart
interval: scans of the same kind are decoded side by side, one lane a restart segment, accumulating into coefficient
arrays. `pixels` dequantises and inverse-transforms, `rgb` upsamples chroma and converts to RGB. Sums in the transform are exact
(a fixed-point matrix in float64), so equal images give equal tensors in any batch.

Defined cases: a null text is empty; the shortest payload is 64 zero bytes; blocks past the payload are zero; the
number of payload blocks is in a comment segment. An image without it yields all its blocks. A truncated or
non-progressive stream raises ValueError. Rows that repeat an id are stored alike. Memory goes with one batch of BATCH
blocks or the longest single text. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow

BATCH = 16384
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)), np.int64)
#: (first coefficient, last, high bit, low bit) of each component's scans.
SCRIPT = [(0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (1, 63, 1, 0), (0, 0, 1, 0)]
_DC = {s: 3 if s < 7 else 6 for s in range(12)}
_AC = {0x06: 2, 0x05: 3, 0x04: 4, 0x00: 4, 0x01: 5, 0x02: 5, 0x03: 5, 0x07: 5, 0x08: 7, 0xF0: 8}
_AC |= {r << 4 | s: 9 for r in range(16) for s in range(1, 9) if r << 4 | s not in _AC}


def canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The DHT body (16 counts, symbols) and symbol -> (code, length)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, code, last = {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    return bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)) + bytes(order), codes


DC_BODY, DC_CODES = canonical(_DC)
AC_BODY, AC_CODES = canonical(_AC)


def _arrays(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    code, size = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s, (c, n) in codes.items():
        code[s], size[s] = c, n
    return code, size


_DC_CODE, _DC_SIZE = _arrays(DC_CODES)
_AC_CODE, _AC_SIZE = _arrays(AC_CODES)
_BITS = np.array([int(i).bit_length() for i in range(2048)], np.int64)


def _extra(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(value >= 0, value, value + (1 << size) - 1).astype(np.uint64)


def pack(lane: np.ndarray, code: np.ndarray, size: np.ndarray, lanes: int, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in lane order -> bytes of all lanes, filled up with ones, stuffed, a restart marker in front of lane i
    where marked[i] >= 0; and each lane's begin, with one end more."""
    bits = np.bincount(lane, weights=size, minlength=lanes).astype(np.int64)
    count = (bits + 7) // 8
    begin = np.cumsum(count) - count
    ends = np.cumsum(size)
    before = np.zeros(lanes, np.int64)
    before[1:] = np.cumsum(bits)[:-1]
    at = ends - size - before[lane] + 8 * begin[lane]
    fill = 8 * count - bits
    code = np.concatenate([code, (np.uint64(1) << fill.astype(np.uint64)) - np.uint64(1)])
    size, at = np.concatenate([size, fill]), np.concatenate([at, 8 * begin + bits])
    word = code << (64 - size - (at & 7)).clip(0, 63).astype(np.uint64)
    word[size == 0] = 0
    total = int(count.sum())
    flat = np.zeros(total + 8)
    for b in range(8):
        part = word >> np.uint64(56 - 8 * b) & np.uint64(255)
        some = part > 0
        if b and not some.any():
            continue
        flat += np.bincount((at[some] >> 3) + b, weights=part[some], minlength=total + 8)[: total + 8]
    raw = flat[:total].astype(np.uint8)
    full = raw == 255
    owner = np.repeat(np.arange(lanes), count)
    marks = np.cumsum(marked >= 0)
    place = np.arange(total) + np.cumsum(full) - full + 2 * marks[owner]
    out = np.zeros(total + int(full.sum()) + 2 * int(marks[-1]), np.uint8)
    out[place] = raw
    stuffed = np.zeros(lanes + 1, np.int64)
    stuffed[1:] = np.cumsum(np.bincount(owner[full], minlength=lanes) + count)
    starts = stuffed + 2 * np.concatenate([[0], marks])
    has = marked >= 0
    out[starts[:-1][has]] = 255
    out[starts[:-1][has] + 1] = 0xD0 + marked[has]
    return out, starts


def _first_ac(coef: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (lane, code, size) of a band's first scan."""
    value = np.sign(coef) * (np.abs(coef) >> low)
    lanes, n = value.shape
    some = value != 0
    k = np.arange(n)
    last = np.maximum.accumulate(np.where(some, k, -1), 1)
    before = np.concatenate([np.full((lanes, 1), -1), last[:, :-1]], 1)
    run = k - before - 1
    size = _BITS[np.abs(value)]
    symbol = (run & 15) << 4 | size
    zrl = run >> 4
    zcode, zsize = AC_CODES[0xF0]
    code, bits = np.zeros((lanes, n + 1), np.uint64), np.zeros((lanes, n + 1), np.int64)
    runs = np.array([sum(zcode << zsize * i for i in range(z)) for z in range(4)], np.uint64)
    own = _AC_CODE[symbol] << size.astype(np.uint64) | _extra(value, size)
    width = _AC_SIZE[symbol] + size
    code[:, :n] = np.where(some, runs[zrl] << width.astype(np.uint64) | own, 0)
    bits[:, :n] = np.where(some, width + zrl * zsize, 0)
    short = last[:, -1] < n - 1
    code[short, n], bits[short, n] = AC_CODES[0]
    keep = bits > 0
    return np.nonzero(keep)[0], code[keep], bits[keep]


def _refine_ac(coef: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of a band's refinement scan: new coefficients of size 1 and buffered correction bits."""
    value = np.abs(coef) >> low
    lanes, n = value.shape
    fresh = value == 1
    end = np.where(fresh.any(1), n - 1 - np.argmax(fresh[:, ::-1], 1), -1)
    run, held, count = np.zeros(lanes, np.int64), np.zeros(lanes, np.uint64), np.zeros(lanes, np.int64)
    out: list[tuple] = []

    def emit(i, code, size):
        out.append((i, np.broadcast_to(np.asarray(code, np.uint64), i.shape), np.broadcast_to(np.asarray(size, np.int64), i.shape)))

    def flush(i):
        wide = i[count[i] > 32]
        emit(wide, held[wide] >> np.uint64(32), count[wide] - 32)
        emit(i, held[i] & np.uint64(0xFFFFFFFF), np.minimum(count[i], 32))
        held[i], count[i] = 0, 0

    for k in range(n):
        v = value[:, k]
        while len(i := np.flatnonzero((v > 0) & (run > 15) & (k <= end))):
            emit(i, *AC_CODES[0xF0])
            flush(i)
            run[i] -= 16
        run += v == 0
        i = np.flatnonzero(v > 1)
        held[i] = held[i] << np.uint64(1) | (v[i] & 1).astype(np.uint64)
        count[i] += 1
        i = np.flatnonzero(v == 1)
        if len(i):
            symbol = run[i] << 4 | 1
            emit(i, _AC_CODE[symbol] << np.uint64(1) | (coef[i, k] > 0).astype(np.uint64), _AC_SIZE[symbol] + 1)
            flush(i)
            run[i] = 0
    i = np.flatnonzero((run > 0) | (count > 0))
    emit(i, *AC_CODES[0])
    flush(i)
    lane = np.concatenate([o[0] for o in out])
    order = np.argsort(lane, kind="stable")
    code, size = np.concatenate([o[1] for o in out])[order], np.concatenate([o[2] for o in out])[order]
    keep = size > 0
    return lane[order][keep], code[keep], size[keep]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def layout(blocks: int) -> tuple[int, int]:
    """Columns and rows of 16 x 16 units that hold so many blocks, six in a unit: as few columns as a height of at most
    65,520 pixels allows, so that next to no block is left over."""
    units = -(-blocks // 6)
    columns = -(-units // 4095)
    return columns, -(-units // columns)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive image for each payload; lengths are positive multiples of 64."""
    shapes = [layout(len(p) // 64) for p in payloads]
    total = [6 * c * r for c, r in shapes]
    coef = np.zeros((sum(total), 64), np.int64)
    first = np.cumsum([0, *total])
    mark = np.zeros(sum(total), np.int64)
    parts = []
    for p, a, (c, r) in zip(payloads, first[:-1].tolist(), shapes, strict=True):
        n = len(p) // 64
        coef[a : a + n] = np.frombuffer(p, np.int8).reshape(n, 64)
        cuts = [a, a + 4 * c * r, a + 5 * c * r, a + 6 * c * r]
        parts.append(cuts)
        for b, e in zip(cuts, cuts[1:], strict=False):
            mark[b:e] = (np.arange(e - b) - 1) % 8
            mark[b] = -1
    lanes, scans = len(coef), []
    every = np.arange(lanes)
    for low_k, high_k, high, low in SCRIPT:
        if high_k == 0 and not high:
            v = coef[:, 0] >> low
            size = _BITS[np.abs(v)]
            entries = every, _DC_CODE[size] << size.astype(np.uint64) | _extra(v, size), _DC_SIZE[size] + size
        elif high_k == 0:
            entries = every, (coef[:, 0] >> low & 1).astype(np.uint64), np.ones(lanes, np.int64)
        else:
            entries = (_refine_ac if high else _first_ac)(coef[:, low_k : high_k + 1], low)
        scans.append(pack(*entries, lanes, mark))
    out = []
    for p, cuts, (c, r) in zip(payloads, parts, shapes, strict=True):
        head = b"\xff\xd8" + _segment(0xFE, b"blocks=%d" % (len(p) // 64)) + _segment(0xDB, b"\0" + b"\1" * 64)
        head += _segment(0xC2, struct.pack(">BHHB", 8, 16 * r, 16 * c, 3) + b"\1\x22\0\2\x11\0\3\x11\0")
        head += _segment(0xC4, b"\0" + DC_BODY + b"\x10" + AC_BODY) + _segment(0xDD, b"\0\1")
        body = [head]
        for comp in range(3):
            for (low_k, high_k, high, low), (flat, starts) in zip(SCRIPT, scans, strict=True):
                body += [_segment(0xDA, bytes([1, comp + 1, 0, low_k, high_k, high << 4 | low])), flat[starts[cuts[comp]] : starts[cuts[comp + 1]]].tobytes()]
        out.append(b"".join([*body, b"\xff\xd9"]))
    return out


@dataclass
class Image:
    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal and vertical sampling, table
    tables: dict[int, np.ndarray] = field(default_factory=dict)
    grids: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # first block, columns, rows, own columns, own rows
    blocks: int = 0
    payload: int | None = None
    scans: list[tuple] = field(default_factory=list)


_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def parse(data: bytes) -> Image:
    """Headers, tables in force and entropy-coded data of each scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG stream")
    img, at, codes, restart = Image(), 2, {}, 0
    while True:
        if at + 2 > len(data):
            raise ValueError("the stream ends before its end marker")
        if data[at] != 255:
            raise ValueError("no marker where one is due")
        marker = data[at + 1]
        if marker == 0xD9:
            return img
        if marker == 255:
            at += 1
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE and (m := re.fullmatch(rb"blocks=(\d+)", body)):
            img.payload = int(m[1])
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide, t = body[k] >> 4, body[k] & 15
                img.tables[t] = np.frombuffer(body[k + 1 : k + 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                k += 65 + 64 * wide
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                codes[body[k]] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            _, img.height, img.width, n = struct.unpack(">BHHB", body[:6])
            img.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            h, v = max(p[1] for p in img.parts), max(p[2] for p in img.parts)
            units = -(-img.width // (8 * h)), -(-img.height // (8 * v))
            for _, ph, pv, _ in img.parts:
                own = -(-(-(-img.width * ph // h)) // 8)
                img.grids.append((img.blocks, units[0] * ph, units[1] * pv, own, -(-(-(-img.height * pv // v)) // 8)))
                img.blocks += units[0] * ph * units[1] * pv
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a progressive Huffman stream")
        elif marker == 0xDA:
            n = body[0]
            ids = [p[0] for p in img.parts]
            comps = [(ids.index(body[1 + 2 * i]), codes.get(body[2 + 2 * i] >> 4), codes.get(16 | body[2 + 2 * i] & 15)) for i in range(n)]
            low_k, high_k, bits = body[1 + 2 * n : 4 + 2 * n]
            m = _SCAN_END.search(data, at)
            if not m:
                raise ValueError("the stream ends inside a scan")
            img.scans.append((comps, low_k, high_k, bits >> 4, bits & 15, restart, data[at : m.start()]))
            at = m.start()


def order_of(img: Image, comps: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks of a scan in their order, the component of each, blocks in a unit."""
    if len(comps) == 1:
        first, columns, _, own, rows = img.grids[comps[0]]
        blocks = (first + np.arange(rows)[:, None] * columns + np.arange(own)[None, :]).reshape(-1)
        return blocks, np.zeros(len(blocks), np.int64), 1
    h, v = img.parts[comps[0]][1], img.parts[comps[0]][2]
    across, down = img.grids[comps[0]][1] // h, img.grids[comps[0]][2] // v
    cols, which = [], []
    for i, c in enumerate(comps):
        first, columns, _, _, _ = img.grids[c]
        for y in range(img.parts[c][2]):
            for x in range(img.parts[c][1]):
                cols.append((first + (np.arange(down) * img.parts[c][2] + y)[:, None] * columns + (np.arange(across) * img.parts[c][1] + x)[None, :]).reshape(-1))
                which.append(i)
    return np.stack(cols, 1).reshape(-1), np.tile(np.array(which), across * down), len(cols)


@lru_cache(64)
def lookup(body: bytes) -> np.ndarray:
    """16 bits ahead -> symbol | length << 8."""
    out, code, k = np.zeros(1 << 16, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            out[code << 16 - n : code + 1 << 16 - n] = body[k] | n << 8
            code, k = code + 1, k + 1
        code <<= 1
    return out


class Bits:
    """The lanes' bits: entropy-coded data of many scans, cut at restart markers, without stuffing."""

    def __init__(self, datas: list[bytes]):
        flat = np.frombuffer(b"".join([*datas, b"\0" * 8]), np.uint8)
        full = flat[:-1] == 255
        mark = np.flatnonzero(full & (flat[1:] >= 0xD0) & (flat[1:] <= 0xD7))
        keep = np.ones(len(flat), bool)
        keep[1:][full & (flat[1:] == 0)] = False
        keep[mark], keep[mark + 1] = False, False
        ends = np.cumsum([len(d) for d in datas])
        begins = np.sort(np.concatenate([ends - [len(d) for d in datas], mark + 2]))
        self.lanes_of = np.searchsorted(begins, ends) - np.searchsorted(begins, ends - [len(d) for d in datas])
        moved = np.cumsum(keep) - keep
        self.pos = 8 * moved[begins]
        raw = np.concatenate([flat[keep], np.zeros(8, np.uint8)]).astype(np.int64)
        self.word = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        self.most = 8 * (len(self.word) - 1)

    def peek(self, lanes: np.ndarray, n) -> np.ndarray:
        p = np.minimum(self.pos[lanes], self.most)
        return self.word[p >> 3] >> (32 - (p & 7) - n) & (1 << n) - 1

    def symbol(self, lanes: np.ndarray, luts: np.ndarray, table: np.ndarray) -> np.ndarray:
        got = luts[table, self.peek(lanes, 16)]
        if not got.all():
            raise ValueError("a code that no table has")
        self.pos[lanes] += got >> 8
        return got & 255

    def take(self, lanes: np.ndarray, n) -> np.ndarray:
        out = self.peek(lanes, n)
        self.pos[lanes] += n
        return out


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)


def correct(coef: np.ndarray, bits: Bits, lanes: np.ndarray, blocks: np.ndarray, low_k: int, high_k: int, low: int) -> None:
    """Correction bits of all coefficients from low_k on, for lanes that read nothing else in this block."""
    part = coef[blocks, low_k : high_k + 1]
    old = part != 0
    p = np.minimum(bits.pos[lanes][:, None] + np.cumsum(old, 1) - old, bits.most)
    bit = (bits.word[p >> 3] >> (31 - (p & 7)) & 1) << low
    coef[blocks, low_k : high_k + 1] = part + np.sign(part) * bit
    bits.pos[lanes] += old.sum(1)


def scan(coef: np.ndarray, bits: Bits, blocks: np.ndarray, table: np.ndarray, luts: np.ndarray, band: tuple[int, int, int, int]) -> None:
    """blocks, table: lanes x blocks in order, -1 where a lane has no more."""
    low_k, high_k, high, low = band
    lanes = len(blocks)
    before, runs = np.zeros((lanes, len(luts)), np.int64), np.zeros(lanes, np.int64)
    for t in range(blocks.shape[1]):
        cur = np.flatnonzero(blocks[:, t] >= 0)
        at, use = blocks[:, t], table[:, t]
        if low_k == 0 and high:
            coef[at[cur], 0] |= bits.take(cur, 1) << low
        elif low_k == 0:
            size = bits.symbol(cur, luts, use[cur])
            before[cur, use[cur]] += np.where(size > 0, _signed(bits.take(cur, size), size), 0)
            coef[at[cur], 0] = before[cur, use[cur]] << low
        elif not high:
            skip = runs[cur] > 0
            runs[cur[skip]] -= 1
            cur = cur[~skip]
            k = np.full(len(cur), low_k)
            while len(cur):
                symbol = bits.symbol(cur, luts, use[cur])
                run, size = symbol >> 4, symbol & 15
                value = bits.take(cur, np.where((size == 0) & (run < 15), run, size))
                stop = (size == 0) & (run < 15)
                runs[cur[stop]] = (1 << run[stop]) + value[stop] - 1
                k += run
                some = size > 0
                coef[at[cur[some]], np.minimum(k[some], 63)] = _signed(value[some], size[some]) << low
                k += 1
                more = ~stop & (k <= high_k)
                cur, k = cur[more], k[more]
        else:
            b = at[cur]
            ended = runs[cur] > 0
            runs[cur[ended]] -= 1
            run, fresh, pending = np.zeros(len(cur), np.int64), np.zeros(len(cur), np.int64), np.zeros(len(cur), bool)
            if ended.any():
                correct(coef, bits, cur[ended], b[ended], low_k, high_k, low)
                cur, b, ended, run, fresh, pending = cur[~ended], b[~ended], ended[~ended], run[~ended], fresh[~ended], pending[~ended]
            for k in range(low_k, high_k + 1):
                if not len(cur):
                    break
                read = np.flatnonzero(~pending)
                if len(read):
                    symbol = bits.symbol(cur[read], luts, use[cur[read]])
                    r, s = symbol >> 4, symbol & 15
                    stop = (s == 0) & (r < 15)
                    value = bits.take(cur[read], np.where(stop, r, s))
                    runs[cur[read[stop]]] = (1 << r[stop]) + value[stop] - 1
                    ended[read[stop]] = True
                    run[read], pending[read] = r, ~stop
                    fresh[read] = np.where(s > 0, np.where(value > 0, 1, -1), 0) << low
                    if stop.any():
                        correct(coef, bits, cur[ended], b[ended], k, high_k, low)
                        cur, b, run, fresh, pending, ended = cur[~ended], b[~ended], run[~ended], fresh[~ended], pending[~ended], ended[~ended]
                c = coef[b, k]
                old = c != 0
                bit = bits.take(cur[old], 1)
                coef[b[old], k] += np.sign(c[old]) * (bit << low)
                here = np.flatnonzero(~old & pending)
                put = here[run[here] == 0]
                coef[b[put], k] = fresh[put]
                pending[put] = False
                run[here] -= 1


def coefficients(datas: list[bytes]) -> tuple[list[Image], np.ndarray, np.ndarray]:
    """Images, their quantised coefficients (blocks x 64, zigzag) in one array, and each one's first block."""
    images = [parse(d) for d in datas]
    first = np.cumsum([0, *(i.blocks for i in images)])
    coef = np.zeros((int(first[-1]), 64), np.int64)
    rounds: dict[int, dict[tuple, list[tuple[int, tuple]]]] = {}
    for n, img in enumerate(images):
        depth = [0] * len(img.parts)
        for one in img.scans:
            comps, *band, restart, _ = one
            level = max(depth[c[0]] for c in comps) + 1
            for c in comps:
                depth[c[0]] = level
            kind = (tuple(c[1 if band[0] == 0 else 2] for c in comps), tuple(band), restart)
            rounds.setdefault(level, {}).setdefault(kind, []).append((n, one))
    orders: dict[tuple, tuple] = {}
    for level in sorted(rounds):
        for (bodies, band, restart), group in rounds[level].items():
            luts = np.stack([lookup(x) if x else np.zeros(1 << 16, np.int64) for x in bodies])
            bits, blocks, table = Bits([one[-1] for _, one in group]), [], []
            for (n, one), lanes in zip(group, bits.lanes_of.tolist(), strict=True):
                img, comps = images[n], [c[0] for c in one[0]]
                key = (n, tuple(comps))
                if key not in orders:
                    b, t, unit = order_of(img, comps)
                    orders[key] = b + first[n], t, unit
                b, t, unit = orders[key]
                size = unit * restart or len(b)
                if lanes != -(-len(b) // size):
                    raise ValueError("restart markers don't fit the image")
                if pad := lanes * size - len(b):
                    b, t = np.pad(b, (0, pad), constant_values=-1), np.pad(t, (0, pad))
                blocks.append(b.reshape(lanes, size))
                table.append(t.reshape(lanes, size))
            wide = max(b.shape[1] for b in blocks)
            if any(b.shape[1] < wide for b in blocks):
                blocks = [np.pad(b, ((0, 0), (0, wide - b.shape[1])), constant_values=-1) for b in blocks]
                table = [np.pad(b, ((0, 0), (0, wide - b.shape[1]))) for b in table]
            scan(coef, bits, np.concatenate(blocks), np.concatenate(table), luts, band)
    return images, coef, first


_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.5) if u == 0 else 1) / 2 for x in range(8)] for u in range(8)])
#: zigzag coefficient x pixel, in units of 2 ** -16.
_INVERSE = np.round(np.einsum("ux,vy->uvxy", _COS, _COS).reshape(64, 64)[ZIGZAG] * 65536)


def pixels(images: list[Image], coef: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Dequantised and inverse-transformed blocks of all images, as bytes in pixel order."""
    scale = coef.astype(np.float64)
    for img, a in zip(images, first[:-1].tolist(), strict=True):
        for (_, _, _, t), (begin, columns, rows, _, _) in zip(img.parts, img.grids, strict=True):
            if (img.tables[t] != 1).any():
                scale[a + begin : a + begin + columns * rows] *= img.tables[t]
    out = scale @ _INVERSE
    out *= 1 / 65536
    out += 128.5
    return np.clip(out, 0, 255, out=out).astype(np.uint8)


def rgb(img: Image, px: np.ndarray) -> np.ndarray:
    """Full-resolution height x width x 3 tensor of bytes; px: the image's blocks of pixels."""
    planes = []
    h, v = max(p[1] for p in img.parts), max(p[2] for p in img.parts)
    for (_, ph, pv, _), (first, columns, rows, _, _) in zip(img.parts, img.grids, strict=True):
        plane = px[first : first + columns * rows].reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        planes.append(plane.repeat(v // pv, 0).repeat(h // ph, 1)[: img.height, : img.width])
    if len(planes) < 3:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = (p.astype(np.int32) for p in planes)
    cb, cr, y = cb - 128, cr - 128, (y << 16) + 32768
    out = np.stack([y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb], 2) >> 16
    return np.clip(out, 0, 255, out=out).astype(np.uint8)


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * ((-len(raw)) % 64 or (64 if not raw else 0)), len(raw)


def feature(tensor: np.ndarray) -> str:
    """Size, and per colour the mean and mean square in hundredths, from exact integer sums."""
    flat = tensor.reshape(-1, 3).astype(np.uint32)
    n = len(flat)
    return f"{tensor.shape[1]}x{tensor.shape[0]}:" + ",".join(f"{100 * a // n}/{100 * b // n}" for a, b in zip(flat.sum(0, np.int64).tolist(), (flat * flat).sum(0, np.int64).tolist(), strict=True))


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tensors: bool = False) -> DataFrame:
    """Per row what is stored and read back; with tensors also the image and its RGB tensor (height, width, bytes)."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    if tensors:
        names += ["media", "height", "width", "rgb"]
        schema += ", media binary, height int, width int, rgb binary"

    def batch(ids: list, held: list[tuple[bytes, int]]) -> pa.RecordBatch:
        media = encode([p for p, _ in held])
        images, coef, first = coefficients(media)
        px, rows = pixels(images, coef, first), []
        for i, (_, n), m, img, a in zip(ids, held, media, images, first.tolist(), strict=False):
            back = coef[a : a + img.payload].astype(np.int8).tobytes()
            tensor = rgb(img, px[a : a + img.blocks])
            row = (i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(tensor))
            rows.append(row + ((m, tensor.shape[0], tensor.shape[1], tensor.tobytes()) if tensors else ()))
        types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = [], [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append(payload_of(text))
                ids.append(i)
                size += len(held[-1][0]) // 64
                if size >= BATCH:
                    yield batch(ids, held)
                    ids, held, size = [], [], 0
        if held:
            yield batch(ids, held)

    return map_arrow(df.selectExpr(f"cast(`{id_col}` as long) id", f"`{text_col}` text"), run, schema)


def op6_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark.read.parquet(f"{sf_dir}/documents.parquet"))
