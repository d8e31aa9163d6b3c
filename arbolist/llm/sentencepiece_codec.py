"""SentencePiece encoding and decoding on the tokenizers library.

A SentencePiece model file (a protobuf message) is read field by field, and its normaliser, metaspace marker, pieces, scores
and byte fallback are rebuilt as a tokenizers pipeline: a unigram model from the scores, or, for a BPE model, the merges that
its scores order. Batches are encoded by several threads. Parity with the sentencepiece library is verified when a codec is
built (PROBES) and on one document of PARITY_EVERY while encoding; a difference is an error, never a silent result.

Where no piece has a marker behind another character, a text can be cut before any run of markers without any effect on the
pieces. If the normaliser changes nothing else, the words that a batch brings anew are encoded as one batch, once, and the
texts' ids are put together from the words' ids; this also bounds the memory that a very long text takes.

Defined results: null and empty texts have no ids, decode to the empty text and are lossless; texts that the model's
normaliser changes (or that hold the marker itself) are not lossless; repeated rows give repeated results; other columns
are ignored by encode().
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEPT_IN_WORKER, by_batch, col, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
THREADS = 2
PARITY_EVERY = 499
#: Words that a worker keeps the ids of, and the longest of them; beyond, all are forgotten and learnt anew.
KEPT, KEPT_CHARS = 400_000, 64
PROBES = ("", " ", "Hello world", "  two  spaces ", "été naïve Straße 你好 \U0001f600", "tabs\tand\nlines\r\n", "a" * 50, "=" * 33 + " " * 9 + "x", "<s> <unk> </s>", "1234567890 3.14", "\u0000\u0001", "ﬁ ½ Å")
#: What stands in a unigram vocabulary for pieces that no text is cut into, and texts that hold what only looks like a piece.
HIDDEN = "\U0010ffff\U0010fffe{}\U0010ffff"
LIKE_PIECES = re.compile("<0x[0-9A-F]{2}>|\U0010ffff")
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            n = {1: 8, 5: 4}.get(kind)
            n = varint() if n is None and kind == 2 else n
            if n is None or at + n > len(data):
                raise ValueError("not a SentencePiece model")
            value, at = data[at : at + n], at + n
        yield key >> 3, value


@dataclass
class Model:
    """What a model file says. kind: 1 unigram, 2 BPE."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1
    unk_id: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    text = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((text, score, kind))
        elif number == 2:
            spec = dict(fields(value))
            m.kind, m.byte_fallback, m.unk_id = spec.get(3, 1), bool(spec.get(35, 0)), spec.get(40, 0)
            if spec.get(24, 0):
                raise NotImplementedError("white space as a suffix")
        elif number == 3:
            spec = dict(fields(value))
            m.charsmap, m.dummy_prefix, m.squeeze, m.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
    if m.kind not in (1, 2):
        raise NotImplementedError(f"model type {m.kind}")
    return m


def cuttable(m: Model) -> bool:
    return m.escape and not any(MARK in text.lstrip(MARK) for text, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED))


def build(m: Model, prefix: bool | None = None):
    """The tokenizers pipeline of a model. prefix: whether a marker is put before a text (as the model says by default)."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if m.kind == 1:
        top = max((score for _, score, kind in m.pieces if kind == NORMAL), default=0.0)
        scores = {USER_DEFINED: lambda text, score: len(text.encode()) * top - 0.1}
        vocab = [(HIDDEN.format(i) if kind in (UNKNOWN, CONTROL, UNUSED) else text, scores.get(kind, lambda text, score: score)(text, score)) for i, (text, score, kind) in enumerate(m.pieces)]
        t = Tokenizer(models.Unigram(vocab, unk_id=m.unk_id, byte_fallback=m.byte_fallback))
    else:
        usable = {text: (score, i) for i, (text, score, kind) in enumerate(m.pieces) if kind in (NORMAL, USER_DEFINED)}
        merges = []
        for text, (score, i) in usable.items():
            merges += [(-score, i, k, (text[:k], text[k:])) for k in range(1, len(text)) if text[:k] in usable and text[k:] in usable]
        unk = m.pieces[m.unk_id][0]
        t = Tokenizer(models.BPE(vocab={text: i for i, (text, _, _) in enumerate(m.pieces)}, merges=[x[3] for x in sorted(merges)], unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback))
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    marker = MARK if m.escape else " "
    prefix = m.dummy_prefix if prefix is None else prefix
    steps += [normalizers.Prepend(marker)] * prefix + [normalizers.Replace(" ", MARK)] * m.escape
    t.normalizer = normalizers.Sequence(steps)
    if cuttable(m):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if prefix else [])])
    return t


class Codec:
    """Encodes and decodes batches; made once for each Python worker from the bytes of a model file, and kept until another operator runs there."""

    made: dict[int, Codec] = {}

    def __init__(self, data: bytes):
        self.model, self.data = (m := parse_model(data)), data
        self.first, self.rest = build(m), build(m, prefix=False)
        self.hidden = {i for i, p in enumerate(m.pieces) if p[2] in (UNKNOWN, CONTROL, UNUSED)} if m.kind == 1 else set()
        self.by_word = cuttable(m) and m.dummy_prefix and not m.squeeze and not m.charsmap
        self.forget()

    @classmethod
    def of(cls, data: bytes, threads: int = THREADS) -> Codec:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        if (k := hash(data)) not in cls.made:
            cls.made[k] = cls(data)
        return cls.made[k]

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.begin, self.same = array("i"), array("q", [0]), array("b")

    def ids_of(self, texts: list[str], prefixed: bool) -> list[list[int]]:
        """Ids of texts; prefixed: each begins with the space that the model puts before a text.

        A unigram model's byte pieces are found in texts by the tokenizers library as if they were words. The few texts that
        hold such a piece's name are encoded by the sentencepiece library.
        """
        got = [x.ids for x in (self.rest if prefixed else self.first).encode_batch_fast(texts, add_special_tokens=False)]
        if self.model.kind == 1:
            for i, t in enumerate(texts):
                if LIKE_PIECES.search(t):
                    got[i] = library(self.data).encode(t[1:] if prefixed else t)
        return got

    def learn(self, words: list[str]) -> None:
        """Keep the ids of words, each with its leading spaces, and whether they decode to the word."""
        got = self.ids_of(words, True)
        for w, x, back in zip(words, got, self.shown(self.rest, got), strict=True):
            self.place[w] = len(self.same)
            self.ids.extend(x)
            self.begin.append(len(self.ids))
            self.same.append(back == w)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids, whether each text is lossless)."""
        if not self.by_word or any(MARK in t for t in texts):
            got = self.ids_of(texts, False)
            same = np.array([x == t for x, t in zip(self.decode(got), texts, strict=True)], bool)
            return np.fromiter(chain.from_iterable(got), np.int32), np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64), same
        # As the marker stands before a text, its first word has a space before it like any other.
        parts = [re.findall(" +[^ ]+| +$", " " + t) if "  " in t or t[:1] == " " else [" " + w for w in t.split(" ")] if t else [] for t in texts]
        if len(self.place) > KEPT:
            self.forget()
        new = list(dict.fromkeys(w for p in parts for w in p if w not in self.place))
        if new:
            self.learn(new)
        counts = np.array([len(p) for p in parts], np.int64)
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        begin, ids, kept = np.array(self.begin, np.int64), np.array(self.ids, np.int32), np.array(self.same, bool)
        size = begin[at + 1] - begin[at]
        ends = np.cumsum(size)
        flat = ids[np.repeat(begin[at] - (ends - size), size) + np.arange(int(size.sum()))]
        words = np.concatenate([[0], np.cumsum(counts)])
        bad = np.concatenate([[0], np.cumsum(~kept[at])])
        if any(len(w) > KEPT_CHARS for w in new):
            self.forget()  # nothing long stays
        return flat, np.concatenate([[0], ends])[words], bad[words[1:]] == bad[words[:-1]]

    def encode(self, texts: list[str]) -> list[list[int]]:
        flat, offsets, _ = self.encode_flat(texts)
        return [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.shown(self.first, ids)

    def shown(self, tokenizer, ids: list[list[int]]) -> list[str]:
        hidden = re.compile(HIDDEN.format("([0-9]+)"))
        name = lambda m: self.model.pieces[int(m[1])][0]
        return [hidden.sub(name, t) if "\U0010ffff" in t and not self.hidden.isdisjoint(x) else t for t, x in zip(tokenizer.decode_batch(ids, skip_special_tokens=False), ids, strict=True)]


KEPT_IN_WORKER.append(Codec.made)


def library(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def verify(data: bytes, texts: list[str]) -> None:
    """Raise where the codec and the sentencepiece library differ."""
    codec, own = Codec.of(data), library(data)
    for t, got in zip(texts, codec.encode(texts), strict=True):
        if got != own.encode(t):
            raise ValueError(f"parity: {t[:80]!r} gives {got[:20]}, not {own.encode(t)[:20]}")


def read_model(spark: SparkSession, path: str) -> bytes:
    """A model file's bytes: from the driver's disk, or from any store Spark reads if the path is a URI."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


MADE = ("n_tokens", "token_ids", "lossless")


def encode(docs: DataFrame, path: str = MODEL, threads: int = THREADS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns to carry, n_tokens, token_ids and lossless (whether decoding gives the text again) for every document.

    Columns to carry may have any name and type, but those named like the last three (or doc_id) are replaced by them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    data = read_model(spark, path)
    verify(data, list(PROBES))
    shared = spark.sparkContext.broadcast(data)  # a vocabulary: of fixed size
    kept = ("doc_id", *(c for c in carry if c not in MADE and c != "doc_id"))
    places = [f"k{i}" for i in range(len(kept))]  # names that clash with nothing

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.of(shared.value, threads)
        texts = [t or "" for t in b["text"].to_pylist()]
        flat, offsets, same = codec.encode_flat(texts)
        if sample := [t for t, c in zip(texts, b["check"].to_pylist(), strict=True) if c]:
            verify(shared.value, sample)
        return pa.RecordBatch.from_arrays([*(b[c] for c in places), pa.array(np.diff(offsets), pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), pa.array(same)], names=[*places, *MADE])

    text = F.col("text").cast("string")
    rows = docs.select(*(col(c).alias(k) for c, k in zip(kept, places, strict=True)), text.alias("text"), F.coalesce(F.pmod(F.xxhash64(text, F.lit(3)), F.lit(PARITY_EVERY)) == 0, F.lit(False)).alias("check"))
    kinds = T.StructType([T.StructField(k, rows.schema[k].dataType) for k in places] + [T.StructField(n, t) for n, t in zip(MADE, (T.IntegerType(), T.ArrayType(T.IntegerType()), T.BooleanType()), strict=True)])
    return rows.mapInArrow(by_batch(run), kinds).select(*(F.col(k).alias(c) for c, k in zip(kept, places, strict=True)), *MADE)


def decode(tokens: DataFrame, path: str = MODEL, threads: int = THREADS) -> DataFrame:
    """doc_id and text from doc_id and token_ids (null: no ids)."""
    spark = tokens.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(read_model(spark, path))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = Codec.of(shared.value, threads).decode([x or [] for x in b["token_ids"].to_pylist()])
        return pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "token_ids").mapInArrow(by_batch(run), f"doc_id {dict(tokens.dtypes)['doc_id']}, text string")
