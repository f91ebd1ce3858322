"""Sets of 64-bit word-shingle hashes, computed for a batch of texts at once in numpy."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _ONE
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BATCH = 250_000


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


#: Powers for the first bytes of any text; longer ones make their own.
UP, DOWN = powers(1 << 16, BASE), powers(1 << 16, INVERSE)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Words are runs of bytes other than ASCII white space, A-Z lower-cased; a text of fewer than n words, but at
    least one, has its whole word sequence as its one shingle; a null, empty or blank text has none."""

    def __init__(self, n: int):
        self.n, self.up, self.down = n, UP, DOWN

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """Sorted distinct hashes of each text, as int64."""
        out, part, size = [], [], 0
        for t in texts:
            raw = (t or "").encode("utf-8", "surrogatepass").translate(LOWER)
            part.append(raw)
            size += len(raw) + 1
            if size > BATCH:
                out += self._batch(part)
                part, size = [], 0
        return out + (self._batch(part) if part else [])

    def _batch(self, raws: list[bytes]) -> list[np.ndarray]:
        buf = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
        if len(buf) > len(self.up):
            self.up, self.down = powers(len(buf), BASE), powers(len(buf), INVERSE)
        space = _SPACE[buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        begin, end = edge[::2], edge[1::2]
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * self.up[: len(buf)], out=sums[1:])
        words = mix((sums[end] - sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))
        bounds = np.searchsorted(begin, np.cumsum([0, *(len(r) + 1 for r in raws)]))
        rolled, k = words, len(words) - self.n + 1
        if k > 0:
            rolled = words[:k]
            for j in range(1, self.n):
                rolled = mix(rolled * np.uint64(BASE) + words[j : j + k])
        found = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= self.n:
                found.append(np.unique(rolled[a : b - self.n + 1].view(np.int64)))
            elif b > a:
                h = np.array([b - a], np.uint64)
                for w in words[a:b]:
                    h = mix(h * np.uint64(INVERSE) + w)
                found.append(h.view(np.int64))
            else:
                found.append(np.zeros(0, np.int64))
        return found
