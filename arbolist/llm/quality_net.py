"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

Tokens are runs of letters and digits, and runs of other characters than white space; a token that repeats the one before
it is one special word. Each word has a sparse random index vector (drawn from its hash). The context vector of a word slot
is the sum of the index vectors of the words beside it over the whole corpus: one pass, which sends a table of fixed size
from each task. A document is the mean and the spread of its words' context vectors, and its length by the logarithm.
The network (one hidden layer) is fitted on a bounded sample of labelled training documents (SAMPLE, SAMPLE_BYTES); its logits are divided by
a temperature fitted on a part of the sample kept back.

Defined results: null and empty texts, and texts without a token, are pooled to zero vectors and scored as such; without
both labels in the sample, every score is the share of label 1 (0 without labels); repeated rows give repeated results;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, emit_array, labelled_sample, sampled_rows, sigmoid, small_batches, summed_array
from .textkit import ALNUM, SPACE, U, Words, mix, slices, text_bytes, words

#: The most labelled documents that the network is fitted on, and the most bytes of their texts.
SAMPLE, SAMPLE_BYTES = 6000, 64 << 20
#: Words that are pooled at once.
PIECE = 1 << 17
#: Word slots, dimensions and nonzeros of an index vector.
SLOTS, DIMS, ONES = 1 << 14, 32, 4
REPEAT = U(0x2545F4914F6CDD1D)


def tokens(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of letters and digits (case kept) and runs of other characters, in order; repeats become one special word."""
    a, b = words(raw, offsets, ALNUM, fold_case=False), words(raw, offsets, ~ALNUM & ~SPACE, fold_case=False)
    start = np.concatenate([a.start, b.start])
    order = np.argsort(start, kind="stable")
    out = Words(start[order], np.concatenate([a.end, b.end])[order], np.concatenate([a.hash, b.hash])[order], a.bounds + b.bounds)
    if len(out.hash) > 1:
        doc = out.doc()
        again = (out.hash[1:] == out.hash[:-1]) & (doc[1:] == doc[:-1])
        out.hash[1:][again] = REPEAT
    return out


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - 14)).astype(np.int64)


def add_contexts(total: np.ndarray, w: Words) -> None:
    """Add to each word's row of the table the index vectors of its neighbours in the document."""
    if len(w.hash) < 2:
        return
    doc, at, h = w.doc(), slot(w.hash), mix(w.hash)
    near = np.flatnonzero(doc[1:] == doc[:-1])
    for k in range(ONES):
        bits = (h >> U(8 * k)).astype(np.int64)
        dim, sign = bits & (DIMS - 1), 1.0 - 2.0 * ((bits >> 6) & 1)
        for own, other in ((near, near + 1), (near + 1, near)):
            total += np.bincount(at[own] * DIMS + dim[other], sign[other], SLOTS * DIMS).astype(np.int64)


def context_table(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of the word slots, over all documents; zero for slots without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS * DIMS, np.int64)
        for b in batches:
            raw, off = text_bytes(b["text"])
            for i, j in slices(off, 1 << 22):
                add_contexts(total, tokens(raw[off[i] : off[j]], off[i : j + 1] - off[i]))
        yield from emit_array(total)

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "part int, blob binary")
    v = summed_array(rows, (SLOTS, DIMS), np.int64).astype(np.float64)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return v.astype(np.float32)


def pooled(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Features of each document: mean and spread of its words' vectors, and the logarithm of its length."""
    w = tokens(raw, offsets)
    n = np.diff(w.bounds)
    out = np.zeros((len(n), 2 * DIMS + 1))
    doc = w.doc()
    for a in range(0, len(doc), PIECE):  # sums, some words at a time
        v, own = table[slot(w.hash[a : a + PIECE])], doc[a : a + PIECE]
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[begin], :DIMS] += np.add.reduceat(v, begin, axis=0)
        out[own[begin], DIMS : 2 * DIMS] += np.add.reduceat(v * v, begin, axis=0)
    some = n > 0
    mean = out[some, :DIMS] / n[some][:, None]
    out[some, :DIMS] = mean
    out[some, DIMS : 2 * DIMS] = np.sqrt(np.maximum(out[some, DIMS : 2 * DIMS] / n[some][:, None] - mean * mean, 0))
    out[:, -1] = np.log1p(n)
    return out


def batch_features(col: pa.Array, table: np.ndarray) -> np.ndarray:
    raw, off = text_bytes(col)
    return np.concatenate([pooled(raw[off[i] : off[j]], off[i : j + 1] - off[i], table) for i, j in slices(off, 1 << 20)])


@dataclass
class Net:
    """Standardisation, two layers and a temperature; without layers, a constant."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    constant: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature) if self.layers else np.full(len(x), self.constant)


def fit(x: np.ndarray, y: np.ndarray, share: float | None = None, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, l2: float = 1e-4) -> Net:
    """Adam on the logistic loss, with rows weighted to the labels' share; the temperature on a fifth kept back."""
    if not len(y) or y.min() == y.max():
        return Net(np.zeros(1), np.ones(1), [], 1.0, float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(3)
    back = np.arange(len(y)) % 5 == 4
    if min(y[~back].min() == y[~back].max(), len(y) < 50):
        back[:] = False
    prior = float(y.mean()) if share is None else share
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    p = [rng.normal(size=(x.shape[1], hidden)) * (2 / x.shape[1]) ** 0.5, np.zeros(hidden), rng.normal(size=hidden) * hidden**-0.5, np.zeros(1)]
    m, v, step, fitted = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0, np.flatnonzero(~back)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(fitted), max(1, len(fitted) // 64)):
            h = np.maximum(z[at] @ p[0] + p[1], 0)
            d = (sigmoid(h @ p[2] + p[3]) - y[at]) * weight[at] / len(at)
            dh = np.outer(d, p[2]) * (h > 0)
            g = [z[at].T @ dh + l2 * p[0], dh.sum(0), h.T @ d + l2 * p[2], np.array([d.sum()])]
            step += 1
            for k in range(4):
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Net(mean, scale, p, 1.0, prior)
    if back.any():
        z, t = net.logits(x[back]), np.exp(np.linspace(-1.5, 2.5, 81))
        loss = [(weight[back] * np.logaddexp(0, np.where(y[back] == 1, -z, z) / k)).sum() for k in t]
        net.temperature = float(t[int(np.argmin(loss))])
    return net


def train(docs: DataFrame, labels: DataFrame, held_out: Column, table: np.ndarray, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> Net:
    """Fit on at most `sample` labelled documents of at most `most` bytes that are not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(table)  # SLOTS x DIMS
    share = labels.where(F.col("quality").isNotNull() & ~held_out).agg(F.avg("quality")).first()[0]
    ids = labelled_sample(docs, labels, "quality", held_out, sample, most)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = batch_features(b["text"], shared.value)
        return pa.RecordBatch.from_arrays([b["y"], pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    rows = sorted((bytes(r["x"]), r["y"]) for r in sampled_rows(docs, ids).mapInArrow(by_batch(run), "y int, x binary").collect())
    order = np.random.default_rng(11).permutation(len(rows))
    rows = [rows[k] for k in order]
    return fit(np.array([np.frombuffer(x) for x, _ in rows]).reshape(-1, 2 * DIMS + 1), np.array([y for _, y in rows]), float(share) if share is not None else None)


def classify(docs: DataFrame, net: Net, table: np.ndarray, held_out: Column, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((net, table))  # of fixed size

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        own, vectors = shared.value
        s = own.score(batch_features(b["text"], vectors))
        return pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(by_batch(run), f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
