"""Language identification by nearest centroid.

A text is a vector of hashed character n-grams (1 to 3 code points of the lower-cased text, every run of other characters
than letters a single space), weighted by TF-IDF and made of unit length; document frequencies are counted over all training
rows. Each language has several centroids, from k-means on the unit sphere over a bounded sample of its distinct labelled
texts (SAMPLE_PER_LANG, SAMPLE). A text gets the language of the centroid with the greatest cosine; below the rejection
distance that its language's own training texts give, `rejected` is true.

Whole texts are scored in one Arrow map without a shuffle, some texts at a time as one matrix; the model (idf, centroids) is
of fixed size for each language.

Defined results: null text or text without a letter is `und` with score 0, and no such text is fitted on; without any
labelled row all are `und`; equal cosines go to the language that sorts first; repeated rows give repeated results; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, emit_array, small_batches, summed_array

DIMS = 1 << 13
#: The most distinct texts that centroids are fitted on, about: of a language, and of all; chosen by a hash of the text.
SAMPLE_PER_LANG, SAMPLE = 400, 16_000
CENTROIDS = 4
LETTER = regex.compile(r"\p{L}")
NO_LETTERS = re.compile(r"[\W\d_]+")
#: Code points, and texts, that are counted at once.
PIECE, ROWS = 1 << 19, 128


def codes(text: str) -> np.ndarray:
    return np.frombuffer(NO_LETTERS.sub(" ", text.lower()).encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(c: np.ndarray, doc: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(slots, documents) of all 1-, 2- and 3-grams of a run of code points; n-grams do not cross documents."""
    h = c * np.uint32(0x9E3779B1)
    yield h >> np.uint32(19), doc
    for k in (1, 2):
        if len(c) > k:
            h = (h[: len(c) - k] ^ c[k:]) * np.uint32(0x85EBCA77)
            whole = slice(None) if doc is None else doc[k:] == doc[:-k]
            yield (h >> np.uint32(19))[whole], None if doc is None else doc[k:][whole]


def counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams over whole texts, a row for each text."""
    out = np.zeros((len(texts), DIMS), np.float32)
    flat = out.reshape(-1)
    held: list[tuple[int, np.ndarray]] = []

    def add() -> None:
        if held:
            c = np.concatenate([x for _, x in held])
            doc = np.repeat([i for i, _ in held], [len(x) for _, x in held])
            for s, d in grams(c, doc):
                at = d * DIMS + s
                low, high = held[0][0] * DIMS, (held[-1][0] + 1) * DIMS
                flat[low:high] += np.bincount(at - low, minlength=high - low).astype(np.float32)
            held.clear()

    size = 0
    for i, t in enumerate(texts):
        c = codes(t)
        if len(c) <= PIECE:
            held.append((i, c))
            size += len(c)
            if size > PIECE:
                add()
                size = 0
            continue
        add()
        size = 0
        for a in range(0, len(c), PIECE):  # pieces overlap by two, and n-grams count where they start
            part = c[a : a + PIECE + 2]
            n = min(PIECE, len(c) - a)
            for k, (s, _) in enumerate(grams(part)):
                out[i] += np.bincount(s[: min(n, len(part) - k)], minlength=DIMS)
    add()
    return out


@dataclass
class LangModel:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    reject_below: np.ndarray

    def vectors(self, texts: list[str]) -> np.ndarray:
        v = counts(texts)
        np.log1p(v, out=v)
        v *= self.idf.astype(np.float32)
        v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)[:, None]
        return v

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        good = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if len(self.langs) else []
        for a in range(0, len(good), ROWS):
            own = good[a : a + ROWS]
            cos = self.vectors([texts[i] for i in own]) @ self.centroids.astype(np.float32).T
            for i, row in zip(own, cos, strict=True):
                k = int(np.argmax(row))
                out[i] = (self.langs[k], float(np.clip(row[k], 0.0, 1.0)), bool(row[k] < self.reject_below[k]))
        return out


def idf_of(frequency: np.ndarray, texts: int) -> np.ndarray:
    return np.log((1 + texts) / (1 + frequency)) + 1


def fit(samples: list[tuple[str, np.ndarray]], idf: np.ndarray | None = None, k: int = CENTROIDS, rounds: int = 12, reject_quantile: float = 0.002) -> LangModel:
    """From (lang, counts) rows: k centroids a language by spherical k-means. idf: of all rows, if these are a sample."""
    samples = [s for s in samples if s[1].any()]
    if not samples:
        return LangModel(np.ones(DIMS), np.zeros((0, DIMS)), [], np.zeros(0))
    samples = sorted(samples, key=lambda s: (s[0], s[1].tobytes()))
    if idf is None:
        idf = idf_of(sum((c > 0).astype(np.int64) for _, c in samples), len(samples))
    langs, cents, reject = [], [], []
    for lang in sorted({lang for lang, _ in samples}):
        own = np.log1p(np.stack([c for own_lang, c in samples if own_lang == lang]).astype(np.float32)) * idf.astype(np.float32)
        own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
        # Start from texts far from each other.
        picked = [int(np.argmax(own @ own.mean(0)))]
        while len(picked) < min(k, len(own)):
            picked.append(int(np.argmin((own @ own[picked].T).max(1))))
        c = own[sorted(set(picked))]
        for _ in range(rounds):
            to = np.argmax(own @ c.T, 1)
            c = np.array([own[to == j].mean(0) if (to == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = np.sort((own @ c.T).max(1))
        langs += [lang] * len(c)
        cents.append(c)
        reject += [float(near[int(reject_quantile * (len(near) - 1))]) * 0.9] * len(c)
    return LangModel(idf, np.vstack(cents).astype(np.float64), langs, np.array(reject))


def train(docs: DataFrame, held_out: Column, per_lang: int = SAMPLE_PER_LANG, sample: int = SAMPLE, **how) -> LangModel:
    """Fit on at most about per_lang distinct labelled texts of each language, and `sample` of all, outside the held-out rows.

    Document frequencies are counted over all training rows. Of the sample only counts come to the driver, not texts.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    place = F.xxhash64("text", F.lit(7))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(place).alias("n")).collect()}
    if not n:
        return fit([])
    each, keep = min(per_lang, max(1, sample // len(n))), F.lit(False)
    for lang, c in n.items():
        keep = keep | ((F.col("lang") == lang) & (F.pmod(place, F.lit(1_000_000)) < int(min(1.0, each / max(1, c)) * 1_000_000)))

    def lettered(col: pa.Array) -> list[str]:
        return [t for t in col.to_pylist() if LETTER.search(t)]

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS + 1, np.int64)
        for b in batches:
            texts = lettered(b["text"])
            for a in range(0, len(texts), ROWS):
                total[:-1] += (counts(texts[a : a + ROWS]) > 0).sum(0)
            total[-1] += len(texts)
        yield from emit_array(total)

    def counted(b: pa.RecordBatch) -> pa.RecordBatch | None:
        own = [(lang, t) for lang, t in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True) if LETTER.search(t)]
        got = [(lang, np.flatnonzero(c).astype(np.uint16), c) for lang, t in own for c in counts([t])]
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1].tobytes() for g in got], pa.binary()), pa.array([g[2][g[1]].tobytes() for g in got], pa.binary())], names=["lang", "at", "n"])

    total = summed_array(rows.select("text").mapInArrow(frequencies, "part int, blob binary"), (DIMS + 1,), np.int64)
    chosen = rows.where(keep).distinct().mapInArrow(by_batch(counted), "lang string, at binary, n binary").collect()  # at most about `sample` rows
    samples = []
    for r in chosen:
        c = np.zeros(DIMS, np.float32)
        c[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["n"], np.float32)
        samples.append((r["lang"], c))
    return fit(samples, idf_of(total[:-1], int(total[-1])), **how)


def identify(docs: DataFrame, model: LangModel, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine with the nearest centroid) and rejected for every document."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # DIMS x centroids: of fixed size for each language

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = shared.value.predict(b["text"].to_pylist())
        cols = [b["doc_id"], b["held_out"], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(by_batch(run), f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, rejected boolean")
