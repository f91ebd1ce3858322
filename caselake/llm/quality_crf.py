"""Quality of documents by a linear-chain conditional random field over their lines.

Every line is labelled good or bad. A line's features are shares of kinds of bytes and of repeated words, the same of
the lines before and after it, and how it differs from them; log-odds are linear in them, and a 2 x 2 matrix scores
neighbouring labels. Training maximises the penalised likelihood of whole label sequences on a bounded sample of
labelled documents (TRAIN_DOCS, the sample's hash order does not depend on table size or row order); scoring runs
forward-backward on every line of every document and averages the marginals, weighted by line length.

Defined cases: a null or empty text is one empty line and gets the score of the learned bias. Lines are separated by
\\n. A document of any length is scored whole, as one chain. Rows that repeat an id are each scored by their text; in
training the smallest text of an id counts. Without any label both classes' weights stay zero and each score is 0.5.
Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow

TRAIN_DOCS, THRESHOLD = 2000, 0.3
_KINDS = [bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"#$%&*+<=>@^_`~\\/{}[]", b"!?", b"|\t", b".,;:", b" ", bytes(range(128, 256))]
SIZE = 3 * (len(_KINDS) + 6) + 4


def line_features(lines: list[str]) -> np.ndarray:
    """One row a line, from that line alone."""
    out = np.zeros((len(lines), len(_KINDS) + 6), np.float32)
    for i, line in enumerate(lines):
        raw = line.encode("utf-8", "replace")
        n = len(raw)
        if not n:
            out[i, -1] = 1
            continue
        words = line.split()
        m = len(words) or 1
        kinds = [(n - len(raw.translate(None, k))) / n for k in _KINDS]
        same = sum(map(str.__eq__, words, words[1:])) / m
        out[i] = [*kinds, 1 - len(set(words)) / m, same, min(n / m, 30) / 30, min(n, 2000) / 2000, min(m, 20) / 20, 0]
    return out


def chain_features(own: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after, a bias, the two ends and the chain's length."""
    n = len(own)
    before, after, ends = np.zeros_like(own), np.zeros_like(own), np.zeros((n, 4), np.float32)
    before[1:], after[:-1] = own[:-1], own[1:]
    ends[:, 0], ends[0, 1], ends[-1, 2], ends[:, 3] = 1, 1, 1, 1 / n
    return np.hstack([own, before, after, ends])


def log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def forward_backward(emit: np.ndarray, move: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """emit: log-odds of good, chains x lines; move: 2 x 2 scores; size: lines of each chain.
    Returns marginals of good, expected label pairs over all chains (2 x 2) and each chain's log partition."""
    chains, lines = emit.shape
    rows = np.arange(chains)
    fore, back = np.zeros((chains, lines, 2)), np.zeros((chains, lines, 2))
    score = np.stack([np.zeros_like(emit), emit], 2)
    fore[:, 0] = score[:, 0]
    for t in range(1, lines):
        fore[:, t] = score[:, t] + log_sum(fore[:, t - 1, :1] + move[0], fore[:, t - 1, 1:] + move[1])
    for t in range(lines - 2, -1, -1):
        ahead = score[:, t + 1] + back[:, t + 1]
        step = log_sum(ahead[:, :1] + move[:, 0], ahead[:, 1:] + move[:, 1])
        back[:, t] = np.where((t + 1 < size)[:, None], step, 0)
    last = fore[rows, size - 1]
    z = log_sum(last[:, 0], last[:, 1])
    good = np.exp(np.clip(fore[:, :, 1] + back[:, :, 1] - z[:, None], -60, 0))
    pairs = np.zeros((2, 2))
    inside = np.arange(1, lines)[None, :] < size[:, None]
    for a in range(2):
        for b in range(2):
            p = fore[:, :-1, a] + move[a, b] + score[:, 1:, b] + back[:, 1:, b] - z[:, None]
            pairs[a, b] = np.exp(np.clip(p, -60, 0))[inside].sum()
    return good, pairs, z


class LineCrf:
    def __init__(self, weights: np.ndarray | None = None, move: np.ndarray | None = None):
        self.weights = np.zeros(SIZE) if weights is None else weights
        self.move = np.zeros((2, 2)) if move is None else move

    def fit(self, chains: list[np.ndarray], labels: list[int], steps: int = 90, rate: float = 0.2, penalty: float = 1e-4) -> LineCrf:
        """Every line takes its document's label; each class weighs as much as the other; Adam on all chains."""
        if not chains:
            return self
        y = np.array(labels, float)
        weigh = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) / [len(c) for c in chains]
        parts, groups = [], {}
        for i, c in enumerate(chains):  # chains of like length side by side
            groups.setdefault(len(c).bit_length(), []).append(i)
        for members in groups.values():
            size = np.array([len(chains[i]) for i in members])
            x = np.zeros((len(members), size.max(), SIZE), np.float32)
            for k, i in enumerate(members):
                x[k, : size[k]] = chains[i]
            own, inside = y[members], np.arange(size.max())[None, :] < size[:, None]
            seen = np.array([[((1 - own) * (size - 1)).sum(), 0], [0, (own * (size - 1)).sum()]])
            parts.append((x.reshape(-1, SIZE), size, own[:, None], np.where(inside, weigh[members][:, None], 0), seen))
        steps_in = max(1, sum((p[1] - 1).sum() for p in parts))
        theta, m, v = np.zeros(SIZE + 4), np.zeros(SIZE + 4), np.zeros(SIZE + 4)
        for k in range(1, steps + 1):
            grad, move = -penalty * theta, theta[SIZE:].reshape(2, 2)
            for flat, size, own, weight, seen in parts:
                emit = (flat @ theta[:SIZE].astype(np.float32)).reshape(len(size), -1).astype(float)
                good, pairs, _ = forward_backward(emit, move, size)
                miss = (own - good) * weight
                grad = grad + np.concatenate([miss.reshape(-1) @ flat / len(chains), ((seen - pairs) / steps_in).reshape(-1)])
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
            theta[SIZE:] = np.clip(theta[SIZE:], -2, 2)
        self.weights, self.move = theta[:SIZE], theta[SIZE:].reshape(2, 2)
        return self

    def marginals(self, features: np.ndarray) -> np.ndarray:
        """Of one document's lines."""
        return forward_backward((features @ self.weights)[None], self.move, np.array([len(features)]))[0][0]

    def scores(self, texts: list[str | None]) -> list[float]:
        """Length-weighted mean of the marginals; documents of like numbers of lines run side by side."""
        split = [(t or "").split("\n") for t in texts]
        own = line_features([line for lines in split for line in lines])
        out, groups, at = [0.0] * len(texts), {}, 0
        for i, lines in enumerate(split):
            f = chain_features(own[at : at + len(lines)])
            at += len(lines)
            w = np.array([len(x) for x in lines], float) + 1
            if len(lines) > 256:
                out[i] = float(w @ self.marginals(f) / w.sum())
            else:
                groups.setdefault(len(lines).bit_length(), []).append((i, f @ self.weights, w))
        for found in groups.values():
            size = np.array([len(e) for _, e, _ in found])
            emit, weigh = np.zeros((len(found), size.max())), np.zeros((len(found), size.max()))
            for k, (_, e, w) in enumerate(found):
                emit[k, : len(e)], weigh[k, : len(e)] = e, w
            good, _, _ = forward_backward(emit, self.move, size)
            for (i, _, _), s in zip(found, (good * weigh).sum(1) / weigh.sum(1), strict=True):
                out[i] = float(s)
        return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> LineCrf:
    """Fits on at most `bound` labelled documents that are not held out, the first by hash of their id. Only those
    rows' features come to the driver, one text an id."""
    known = labels.where("quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [chain_features(line_features((t or "").split("\n"))) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes() for x in made], pa.binary()), b.column(1), b.column(2)], ["f", "quality", "doc_id"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("text", "quality", "doc_id")
    got = map_arrow(rows, run, "f binary, quality int, doc_id long").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["f"]))
    return LineCrf().fit([np.frombuffer(r["f"], np.float32).reshape(-1, SIZE) for r in got], [r["quality"] for r in got])


def _scored(docs: DataFrame, model: LineCrf, kept: list[str], name: str, least: float | None = None) -> DataFrame:
    """The columns in `kept` and the score as `name`; with `least`, only rows that reach it."""
    weights, move = model.weights, model.move
    fields = [docs.schema[c] for c in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{name}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = LineCrf(weights, move)
        for b in batches:
            got = pa.array(crf.scores(b.column(b.num_columns - 1).to_pylist()), pa.float64())
            out = pa.RecordBatch.from_arrays([*b.columns[:-1], got], [*b.schema.names[:-1], name])
            yield out if least is None else out.filter(pc.greater_equal(got, least))

    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").alias("__text")), run, schema)


def score(docs: DataFrame, model: LineCrf) -> DataFrame:
    """doc_id, score, one per row."""
    return _scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"], "score")


def accepted(docs: DataFrame, model: LineCrf, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at or above the threshold, all their columns as they are."""
    return _scored(docs, model, docs.columns, "__score", threshold).drop("__score")


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
