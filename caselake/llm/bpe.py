"""Byte-level BPE over Arrow batches, with offsets, and its decoding.

Encoding is the tokenizers library's byte-level model. A text is cut where one match of the split pattern surely ends
and the next surely begins: before a single space between two non-spaces. What lies between two cuts is encoded once
and remembered, in two generations of about MEMO pieces each; the ids of a text are those of its
pieces in order. Decoding maps every id to its characters in the vocabulary, these back to bytes by the byte table,
and joins bytes before it decodes UTF-8, so that a character split over two ids comes out whole.

Defined cases: a null text counts as empty and has no ids; strings of special tokens are ordinary text; unknown ids
raise; bytes that end inside a character decode to U+FFFD in `decode_text` and stay as they are in `decode_bytes`.
Very long texts need memory in proportion to one text. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow

MEMO = 300_000


def byte_table() -> dict[str, int]:
    """Character -> byte: printable Latin-1 characters stand for themselves, the other bytes for U+0100 and up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


_CUT = re.compile(r"(?<=\S) (?=\S)")
_AFTER = re.compile(r" (?:\s|\Z)")
_BEFORE = re.compile(r"[^\S ] ")


def pieces(text: str) -> list[str]:
    """Cuts before single spaces between non-spaces; the pieces joined are the text."""
    parts = _CUT.split(text) if text.startswith(" ") or _AFTER.search(text) or _BEFORE.search(text) else text.split(" ")
    return [parts[0], *[" " + p for p in parts[1:]]]


class ByteBpe:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        chars = byte_table()
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.bytes = {i: bytes(chars[c] for c in token) for token, i in vocab.items() if all(c in chars for c in token)}
        self.width = np.zeros(max(self.bytes) + 1, np.int64)
        for i, x in self.bytes.items():
            self.width[i] = len(x)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, found: Iterable[str]) -> None:
        """Encodes the pieces not known yet. Those that can stand side by side go through the model as one text, whose
        ids are dealt out again by their widths in bytes."""
        memo, older, new = self.memo, self.older, []
        for p in set(found).difference(memo):
            if p in older:
                memo[p] = older[p]
            else:
                new.append(p)
        side = [p for p in new if len(p) > 1 and p[0] == " " and not p[1].isspace() and not p[-1].isspace()]
        for at in range(0, len(side), 20_000):
            part = side[at : at + 20_000]
            ids = np.array(self.model.encode("".join(part), add_special_tokens=False).ids, np.int32)
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(p.encode()) for p in part])) + 1
            flat, start = ids.tobytes(), 0
            for p, end in zip(part, (4 * ends).tolist(), strict=True):
                memo[p] = flat[start:end]
                start = end
        for p in set(new).difference(side):
            memo[p] = np.array(self.model.encode(p, add_special_tokens=False).ids, np.int32).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.memo) > MEMO:
            self.memo, self.older = {}, self.memo
        cut = [pieces(t or "") for t in texts]
        self.learn(chain.from_iterable(cut))
        get = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(get, found)), np.int32) for found in cut]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def offsets(self, ids: list[int]) -> list[int]:
        """Byte offset of each id's first byte in the UTF-8 text."""
        at, out = 0, []
        for i in ids:
            out.append(at)
            at += len(self.bytes[i])
        return out

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode_text(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


def _path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, ids array<int>, offsets array<long> (byte offsets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(_path(path))
        for b in batches:
            ids = [x.tolist() for x in bpe.encode_all(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.offsets(x) for x in ids], pa.list_(pa.int64()))], ["id", "ids", "offsets"])

    return map_arrow(df.selectExpr(f"cast(`{id_col}` as long) id", f"`{text_col}` text"), run, "id long, ids array<int>, offsets array<long>", rows=64)


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """id, ids -> id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(_path(path))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode_text(x or []) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return map_arrow(df.select("id", "ids"), run, "id long, text string", rows=64)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: id, n_tokens, digest of the ids, digest and equality of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(_path(path))
        digits: dict[int, str] = {i: str(i) for i in bpe.bytes}
        for b in batches:
            n, a, d, same = [], [], [], []
            texts = b.column(1).to_pylist()
            for text, ids in zip(texts, map(np.ndarray.tolist, bpe.encode_all(texts)), strict=True):
                back = bpe.decode_bytes(ids)
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(back).hexdigest())
                same.append(back == (text or "").encode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d), pa.array(same)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])

    return map_arrow(df.selectExpr(f"cast(`{id_col}` as long) id", f"`{text_col}` text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
