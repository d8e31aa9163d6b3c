"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. Documents' labels become token
labels: in a toxic training document a token is toxic if its word, counted by distinct neighbour pairs (so that copies of
one document count once), is far likelier in toxic than in other documents. The chain has two states; its potentials come
from the words at and beside the token and from the transition; words that the fitted segments lack weigh nothing. Forward-backward gives the marginals; runs of tokens of
at least SPAN are the offending spans (code points), and a logistic map of the marginals' sum and maximum is the score.

The model is fitted on the driver from a bounded sample of labelled training documents (SAMPLE, SAMPLE_BYTES). Of its pieces of
SEGMENT tokens the chain is fitted on at most `segments` (3,000) with a toxic token and as many others, chosen at random; words
that stand in dropped pieces alone weigh nothing. All texts are scored
whole in one Arrow map without a shuffle: a slice of many documents is one chain, cut by transitions that forget the state
at document borders, and is run in blocks, so that the work in numpy grows with the number of tokens.

Defined results: null and empty texts, and texts without a token, have no span and the score of no evidence; without both
labels in the sample every score is the share of toxic ones (0 without labels); repeated rows give repeated results; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, labelled_sample, logistic, sampled_rows, sigmoid, small_batches
from .textkit import ALNUM, U, mix, slices, text_bytes, words

#: The most labelled documents that the model is fitted on, and the most bytes of their texts.
SAMPLE, SAMPLE_BYTES = 8000, 32 << 20
BITS, SEGMENT, SPAN = 18, 32, 0.5
PLACES = 3


def beside(v: np.ndarray, doc: np.ndarray, none: int) -> list[np.ndarray]:
    """Of a value for each token: its own, and those of the tokens before and after it in its document, else `none`."""
    before, after = np.full_like(v, none), np.full_like(v, none)
    same = doc[1:] == doc[:-1]
    before[1:][same], after[:-1][same] = v[:-1][same], v[1:][same]
    return [v, before, after]


@dataclass
class Chain:
    """keys: the word's hash in each slot; weights: of the slots' words, by place (itself, before, after) and, last, of none.

    trans[i, j]: log-potential from state i to j; begin: of a first state 1.
    """

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    begin: float
    calibration: np.ndarray

    def emission(self, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        at = (h >> U(64 - BITS)).astype(np.int64)
        at[self.keys[at] != h] = 1 << BITS
        return self.bias + sum(w[x] for w, x in zip(self.weights, beside(at, doc, 1 << BITS), strict=True))

    def factors(self, e: np.ndarray, first: np.ndarray, cols: int, block: int) -> np.ndarray:
        """The transitions into each token with its emission, as (step, from, to, column) of `cols` blocks; places beyond the tokens change nothing."""
        n, x, t = len(e), np.exp(np.clip(e, -30, 30)), np.exp(self.trans)
        m = np.empty((cols * block, 2, 2))
        m[:n, :, 0] = t[:, 0]
        m[:n, :, 1] = t[:, 1] * x[:, None]
        at = np.flatnonzero(first)
        m[at, :, 0] = 1.0
        m[at, :, 1] = (np.exp(self.begin) * x[at])[:, None]
        m[n:] = np.eye(2)
        m /= m.sum((1, 2), keepdims=True)
        return np.ascontiguousarray(m.reshape(cols, block, 2, 2).transpose(1, 2, 3, 0))

    def marginals(self, e: np.ndarray, first: np.ndarray, block: int = 256, piece: int = 1 << 19) -> np.ndarray:
        """Probability of state 1 of each token of a run of documents; first: whether a token begins its document.

        Runs of more than `piece` tokens are taken in pieces, twice: for the products of their factors, and for the marginals.
        """
        if not len(e):
            return np.zeros(0)
        parts = []
        for a in range(0, len(e), piece):
            cols = -(-min(piece, len(e) - a) // block)
            m = self.factors(e[a : a + piece], first[a : a + piece], cols, block)
            prod = m[0].copy()
            for k in range(1, block):
                (a0, a1), (b0, b1) = prod
                (p, q), (r, s) = m[k]
                prod = np.array([[a0 * p + a1 * r, a0 * q + a1 * s], [b0 * p + b1 * r, b0 * q + b1 * s]])
                prod /= prod.sum((0, 1))
            parts.append((a, cols, prod, m if len(e) <= piece else None))
        own = np.concatenate([p[2] for p in parts], 2).transpose(2, 0, 1).tolist()
        into, back = np.empty((len(own), 2)), np.empty((len(own), 2))
        v = (1.0, 0.0)
        for c in range(len(own)):  # a step a block
            into[c] = v
            (a, b), (p, q) = own[c]
            v = (v[0] * a + v[1] * p, v[0] * b + v[1] * q)
            z = v[0] + v[1]
            v = (v[0] / z, v[1] / z)
        v = (1.0, 1.0)
        for c in range(len(own) - 1, -1, -1):
            back[c] = v
            (a, b), (p, q) = own[c]
            v = (a * v[0] + b * v[1], p * v[0] + q * v[1])
            z = v[0] + v[1]
            v = (v[0] / z, v[1] / z)
        out, done = [], 0
        for a, cols, _, m in parts:
            n = min(piece, len(e) - a)
            m = self.factors(e[a : a + piece], first[a : a + piece], cols, block) if m is None else m
            alpha = np.empty((block, 2, cols))
            f = into[done : done + cols].T
            for k in range(block):
                f = np.array([f[0] * m[k, 0, 0] + f[1] * m[k, 1, 0], f[0] * m[k, 0, 1] + f[1] * m[k, 1, 1]])
                f /= f.sum(0)
                alpha[k] = f
            g = back[done : done + cols].T
            for k in range(block - 1, -1, -1):
                h = alpha[k] * g
                alpha[k, 1] = h[1] / h.sum(0)
                g = np.array([m[k, 0, 0] * g[0] + m[k, 0, 1] * g[1], m[k, 1, 0] * g[0] + m[k, 1, 1] * g[1]])
                g /= g.sum(0)
            out.append(alpha[:, 1].T.reshape(-1)[:n])
            done += cols
        return np.concatenate(out)

    def score(self, marg: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """A document's score from the marginals of its tokens."""
        if len(self.calibration) == 1:
            return np.full(len(bounds) - 1, self.calibration[0])
        return sigmoid(np.hstack([evidence(marg, bounds), np.ones((len(bounds) - 1, 1))]) @ self.calibration)


def evidence(marg: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each document: the sum of its offending tokens' marginals, by its logarithm, and the maximum of all; 0 without tokens."""
    some = np.diff(bounds) > 0
    total, top = np.zeros(len(some)), np.zeros(len(some))
    if some.any():
        total[some] = np.add.reduceat(np.where(marg >= SPAN, marg, 0.0), bounds[:-1][some])
        top[some] = np.maximum.reduceat(marg, bounds[:-1][some])
    return np.stack([np.log1p(total), top], 1)


def token_labels(docs: list[np.ndarray], y: np.ndarray, least: int = 5, odds: float = 3.0) -> list[np.ndarray]:
    """Labels of the tokens of labelled documents: see the module's docstring. A toxic word needs `least` documents and as many neighbour pairs."""
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    h = np.concatenate(docs)
    around = np.zeros_like(h)
    around[1:-1] = mix(h[:-2] * U(3) + h[2:] * U(5))

    def distinct(at: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words, and with how many values of `beside` each stands."""
        _, one = np.unique(mix(h[at]) + mix(beside[at]) * U(7), return_index=True)
        return np.unique(h[at][one], return_counts=True)

    toxic, rest = y[doc] == 1, y[doc] == 0
    word, n = distinct(toxic, around)
    _, in_docs = distinct(toxic, doc.astype(np.uint64))
    other, m = distinct(rest, around)
    at = np.searchsorted(other, word).clip(0, max(0, len(other) - 1))
    back = np.where(other[at] == word, m[at], 0) if len(other) else np.zeros(len(word))
    log_odds = np.log((n + 0.5) / max(1, n.sum())) - np.log((back + 0.5) / max(1, m.sum()))
    found = word[(n >= least) & (in_docs >= least) & (log_odds >= odds)]
    return [np.isin(d, found) & bool(k) for d, k in zip(docs, y, strict=True)]


def fit(docs: list[np.ndarray], y: np.ndarray, share: float | None = None, rounds: int = 50, rate: float = 1.0, segments: int = 3000) -> Chain:
    """From the documents' word hashes and labels; share: of label 1 among all labelled rows, if the sample's is another."""
    blank = lambda p: Chain(np.zeros(1 << BITS, np.uint64), np.zeros((PLACES, (1 << BITS) + 1)), 0.0, np.zeros((2, 2)), 0.0, np.array([p]))
    if not len(y) or y.min() == y.max():
        return blank(float(y.mean()) if len(y) else 0.0)
    labels = token_labels(docs, y)
    # Segments with a toxic token, and others.
    rng, hot, cold = np.random.default_rng(1), [], []
    for i, d in enumerate(docs):
        for a in range(0, len(d), SEGMENT):
            (hot if labels[i][a : a + SEGMENT].any() else cold).append((i, a))
    take = [part[k] for part in (hot, cold) for k in rng.permutation(len(part))[:segments]]
    if not hot:
        return blank(float(y.mean()) if share is None else share)
    n = len(take)
    fs, ys, on = np.zeros((PLACES, SEGMENT, n), np.uint64), np.zeros((SEGMENT, n)), np.zeros((SEGMENT, n), bool)  # hash 0: no word
    for c, (i, a) in enumerate(take):
        b = min(a + SEGMENT, len(docs[i]))
        on[: b - a, c], ys[: b - a, c] = True, labels[i][a:b]
        for k, move in enumerate((0, -1, 1)):
            lo, hi = max(0, a + move), min(len(docs[i]), b + move)
            fs[k, lo - a - move : hi - a - move, c] = docs[i][lo:hi]
    used, fs = np.unique(fs, return_inverse=True)
    fs, table = fs.reshape(PLACES, SEGMENT, n), np.zeros((PLACES, len(used)))
    chain = blank(0.0)
    chain.bias = -5.0
    both = on[1:] & on[:-1]
    seen = np.bincount((2 * ys[:-1] + ys[1:]).astype(np.int64)[both], minlength=4).reshape(2, 2)
    speed, others = np.full_like(table, 1e-8), np.full(6, 1e-8)
    for _ in range(rounds):
        e = chain.bias + sum(w[f] for w, f in zip(table, fs, strict=True))
        x, t = np.exp(np.clip(np.where(on, e, 0.0), -30, 30)), np.exp(chain.trans)
        alpha, beta = np.empty((SEGMENT, 2, n)), np.ones((SEGMENT, 2, n))
        f = np.stack([np.ones(n), np.exp(chain.begin) * x[0]])
        alpha[0] = f / f.sum(0)
        for k in range(1, SEGMENT):
            f = np.stack([alpha[k - 1, 0] * t[0, 0] + alpha[k - 1, 1] * t[1, 0], (alpha[k - 1, 0] * t[0, 1] + alpha[k - 1, 1] * t[1, 1]) * x[k]])
            alpha[k] = np.where(on[k], f / f.sum(0), alpha[k - 1])
        pair = np.zeros((2, 2))
        for k in range(SEGMENT - 2, -1, -1):
            nxt = beta[k + 1] * np.stack([np.ones(n), x[k + 1]])
            g = np.stack([t[0, 0] * nxt[0] + t[0, 1] * nxt[1], t[1, 0] * nxt[0] + t[1, 1] * nxt[1]])
            beta[k] = np.where(on[k + 1], g / g.sum(0), beta[k + 1])
            xi = alpha[k][:, None] * t[:, :, None] * nxt[None]
            xi /= xi.sum((0, 1))
            pair += (xi * both[k]).sum(2)
        p = alpha * beta
        p = p[:, 1] / p.sum(1)
        miss = np.where(on, ys - p, 0.0)
        for k in range(PLACES):
            g = np.bincount(fs[k].ravel(), miss.ravel(), len(used)) / n - 1e-5 * (1 + 20 * (k > 0)) * table[k]
            speed[k] += g * g
            table[k] += rate * g / np.sqrt(speed[k])
        g = np.concatenate([(seen - pair).ravel(), [miss.sum(), (ys[0] - p[0]).sum()]]) / n
        others += g * g
        g *= 0.2 * rate / np.sqrt(others)
        chain.trans, chain.bias, chain.begin = chain.trans + g[:4].reshape(2, 2), chain.bias + g[4], chain.begin + g[5]
    # Of words that meet in a slot, the one with the greatest weight keeps it.
    at = (used >> U(64 - BITS)).astype(np.int64)
    order = np.argsort(np.abs(table).max(0), kind="stable")
    order = order[used[order] != 0]
    chain.keys[at[order]] = used[order]
    kept = np.flatnonzero((chain.keys[at] == used) & (used != 0))
    chain.weights[:, at[kept]] = table[:, kept]
    chain.weights[:, -1] = table[:, used == 0].sum(1) * [0, 1, 1]
    # Toxic segments are commoner among the fitted ones than among all.
    chain.bias += float(np.log(min(1.0, segments / max(1, len(cold))) / min(1.0, segments / len(hot))))
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    first = np.zeros(bounds[-1], bool)
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    marg = chain.marginals(chain.emission(np.concatenate(docs), np.repeat(np.arange(len(docs)), np.diff(bounds))), first)
    prior = y.mean() if share is None else share
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    chain.calibration = logistic(evidence(marg, bounds), y, weight)
    return chain


def train(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> Chain:
    """Fit on at most `sample` labelled documents of at most `most` bytes that are not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    share = labels.where(F.col("toxic").isNotNull() & ~held_out).agg(F.avg("toxic")).first()[0]
    ids = labelled_sample(docs, labels, "toxic", held_out, sample, most)

    def hashed(b: pa.RecordBatch) -> pa.RecordBatch:
        w = words(*text_bytes(b["text"]), ALNUM)
        rows = [w.hash[i:j].tobytes() for i, j in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
        return pa.RecordBatch.from_arrays([b["y"], pa.array(rows, pa.binary())], names=["y", "w"])

    rows = sorted((bytes(r["w"]), r["y"]) for r in sampled_rows(docs, ids).mapInArrow(by_batch(hashed), "y int, w binary").collect())
    return fit([np.frombuffer(w, np.uint64) for w, _ in rows], np.array([y for _, y in rows]), float(share) if share is not None else None)


def spans_of(marg: np.ndarray, start: np.ndarray, end: np.ndarray, bounds: np.ndarray, points: np.ndarray, begins: np.ndarray) -> Iterator[list[dict]]:
    """For each document its spans: runs of tokens of at least SPAN, as code points of the document, and their marginals' maximum.

    points: code points before each byte; begins: the first byte of each document.
    """
    hit = marg >= SPAN
    for a, b, zero in zip(bounds[:-1], bounds[1:], points[begins], strict=True):
        at = np.flatnonzero(hit[a:b]) + a
        runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []
        yield [{"start": int(points[start[r[0]]] - zero), "end": int(points[end[r[-1]]] - zero), "p": float(marg[r].max())} for r in runs]


def tag(docs: DataFrame, chain: Chain, held_out: Column, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (start, end, p) for every document."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(chain)  # of fixed size

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raw, off = text_bytes(b["text"])
        scores, spans = [], []
        for i, j in slices(off):
            part, own = raw[off[i] : off[j]], off[i : j + 1] - off[i]
            w = words(part, own, ALNUM)
            first = np.zeros(len(w.hash), bool)
            first[w.bounds[:-1][np.diff(w.bounds) > 0]] = True
            marg = shared.value.marginals(shared.value.emission(w.hash, w.doc()), first)
            scores.append(shared.value.score(marg, w.bounds))
            if (marg >= SPAN).any():
                points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                spans += spans_of(marg, w.start, w.end, w.bounds, points, own[:-1])
            else:
                spans += [[]] * (j - i)
        score = np.concatenate(scores)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        return pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(spans, kind)], names=["doc_id", "held_out", "score", "predicted", "spans"])

    rows = docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(by_batch(run), f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,p:double>>")
