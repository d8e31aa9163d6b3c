"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of a document's words; a passage is the TF-IDF vector of its hashed words. A distributed randomised SVD
gives the latent space: every task adds its passages' share of A'AX for a random X to a table of fixed size, and the driver
factors the sum (a core matrix of RANK columns, by Nystrom's formula). The passages' frequencies are counted over all
documents, and the space is fitted on all their distinct texts: no sample is taken. In that space, made of equal variance in each direction,
all windows of all documents are compared by cosine with the benchmark items: in one pass over the texts for at most about ITEMS items.
Words are folded by Unicode's compatibility normalisation and lower case; a word that repeats the word before it has no
vector (runs of one word would fill passages), but counts like any other in the exact checks.
Where a window is near an item, the words around it are checked exactly: the longest common subsequence must cover at least
LCS of the item's words, and, where the item states an answer (after "Answer:"), at least ANSWER of the answer's words (of
other items the last sentence's share is given, but not asked for), so paraphrases that keep most words in order are found and chance neighbours are not.

Windows overlap by three quarters or two thirds, and each item has windows of a length near its own, so that one of them holds
little else. Long documents are searched by pieces that overlap by the longest window, so memory does not grow with a text. An
item longer than the longest window is searched by pieces of that length, each with a vector of its own, and the words around
the place that a piece gives the whole item are checked. Besides, all places that hold an item's words without a gap are
found exactly, whatever its length, by hashes of its first words (cosine 1).

Defined results: null and empty texts and items without words match nothing; a document that repeats an item has one row for
it, its best; repeated rows give repeated results; an empty benchmark gives no rows; other columns are ignored by search()
and pass through in drop_contaminated().
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import col, emit_array, lean, small_batches, summed_array
from .textkit import _STEP, ALNUM, U, Words, mix, slices, text_bytes, words

BITS, RANK, OVER = 14, 112, 16
#: Words of a passage that the latent space is fitted on, and the lengths that windows can have.
FIT, LENGTHS = 48, (12, 16, 24, 32, 48, 64, 96, 128)
#: Items, and bytes of their texts, that one pass over the documents searches; more items take more passes.
ITEMS, ITEM_BYTES = 16_384, 32 << 20
#: Words of a document that are made into windows at once (a multiple of every step between windows).
PIECE = 1 << 16
#: Words at an item's start by which exact copies are found: the greatest of these that it has.
STARTS = (1, 2, 4, 8)
#: Tasks that fit the latent space at least, and passages for each further one (some 75 MB of text): each task sends a table of
#: fixed size, 8 MB, so that these stay a small part of the input.
FIT_TASKS, FIT_PASSAGES = 8, 1 << 18
#: Rows that segment_sums() adds up in one step, sums that row_sums() holds in the processor's cache meanwhile, and words of passages
#: that a task holds before it adds them to its table.
GROUP, CACHED, HELD = 16, 1024, 1 << 19
COSINE, LCS, ANSWER = 0.45, 0.6, 0.5


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - BITS)).astype(np.int64)


def passages(w: Words, size: int) -> np.ndarray:
    """For each word the passage that it is in; passages do not cross documents."""
    place = np.arange(len(w.hash)) - np.repeat(w.bounds[:-1], np.diff(w.bounds))
    first = place % size == 0
    return np.cumsum(first) - 1


def runs(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, int, int, Words]]:
    """(batch, first row, end row, words) for slices of all batches."""
    for b in batches:
        raw, off = folded(b[column])
        for i, j in slices(off, most):
            yield b, i, j, words(raw[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM)


def folded(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts in compatibility form and lower case (A-Z is folded where words are hashed).

    Of most texts with characters beyond ASCII, all of these are Latin letters that UTF-8 begins with 0xC3: these have no
    other form, and their lower case is another second byte. Texts with any other go through Unicode's tables.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    raw, off = text_bytes(col)
    hard = np.flatnonzero((raw >= 0xC0) & (raw != 0xC3))
    if len(hard):
        mask = np.zeros(len(col), bool)
        mask[np.searchsorted(off, hard, "right") - 1] = True
        # In Python, as Arrow's own normalisation leaves what it decomposes apart. Bytes that are no UTF-8 are replaced.
        own = [unicodedata.normalize("NFKC", t.decode("utf-8", "replace")).lower().replace("ς", "σ") for t in col.filter(pa.array(mask)).cast(pa.binary()).to_pylist()]
        raw, off = text_bytes(pc.replace_with_mask(col, pa.array(mask), pa.array(own, col.type)))
    at = np.flatnonzero(raw[:-1] == 0xC3)
    if len(at):
        raw, second = raw.copy(), raw[at + 1]
        raw[at + 1] += np.where((second >= 0x80) & (second <= 0x9E) & (second != 0x97), 0x20, 0).astype(np.uint8)
        sharp = at[second == 0x9F]
        raw[sharp] = raw[sharp + 1] = ord("s")
    return raw, off


def first_of_runs(h: np.ndarray, doc: np.ndarray | None = None) -> np.ndarray:
    """Whether each word differs from the word before it in its document."""
    out = np.ones(len(h), bool)
    out[1:] = h[1:] != h[:-1]
    if doc is not None:
        out[1:] |= doc[1:] != doc[:-1]
    return out


def once(w: Words) -> Words:
    """Words without those that repeat the word before them."""
    keep = first_of_runs(w.hash, w.doc())
    return Words(w.start[keep], w.end[keep], w.hash[keep], np.concatenate([[0], np.cumsum(keep)])[w.bounds])


@dataclass
class Space:
    """idf of each slot, and the latent space: a row of RANK numbers for each slot, idf and scale included."""

    idf: np.ndarray
    table: np.ndarray


def by_slot(s: np.ndarray) -> np.ndarray:
    """The order of slots, equal ones as they stand."""
    return np.argsort(s.astype(np.uint16), kind="stable")  # BITS are fewer than 16; short integers are sorted by radix


def holders(s: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For each slot the number of passages that have it. Words have slots s and passage numbers p, which ascend."""
    order = by_slot(s)
    s, p = s[order], p[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (p[1:] != p[:-1])
    return np.bincount(s[new], minlength=1 << BITS)


def idf_of(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(inverse passage frequency of each slot, passages), over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS) + 1, np.int64)
        for _, _, _, w in runs(batches):
            if len((w := once(w)).hash):
                p = passages(w, FIT)
                total[:-1] += holders(slot(w.hash), p)
                total[-1] += p[-1] + 1
        yield from emit_array(total)

    c = summed_array(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "part int, blob binary"), ((1 << BITS) + 1,), np.int64)
    return np.log((1 + c[-1]) / (1 + c[:-1])).astype(np.float32), int(c[-1])


def sampled(docs: DataFrame, sample: int) -> DataFrame:
    """At most about `sample` distinct texts, chosen by a hash: copies of a text count once. Neither search() nor drop_contaminated() uses it."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    share = min(1.0, sample / max(1, texts.agg(F.approx_count_distinct(F.xxhash64("text"))).first()[0]))
    return texts.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000)).distinct()


def row_sums(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each column of `at` the sum of these rows of table, some CACHED sums at a time."""
    out, more = np.empty((at.shape[1], table.shape[1]), table.dtype), np.empty((CACHED, table.shape[1]), table.dtype)
    for a in range(0, len(out), CACHED):
        part = out[a : a + CACHED]
        np.take(table, at[0, a : a + CACHED], axis=0, out=part, mode="clip")  # clip: no copy of out
        for own in at[1:]:
            part += np.take(table, own[a : a + CACHED], axis=0, out=more[: len(part)], mode="clip")
    return out


def segment_sums(table: np.ndarray, at: np.ndarray, size: np.ndarray, group: int = GROUP) -> np.ndarray:
    """For each segment (size[i] entries of `at`, 1 or more) the sum of its rows of table, whose last row is zeros.

    By `group` rows at a time: each step adds whole rows to sums in the cache, several times as fast as reduceat over an axis.
    """
    while True:
        groups = -(-size // group)
        room = np.full(int(groups.sum()) * group, len(table) - 1, np.int64)
        room[np.arange(len(at)) + np.repeat((np.cumsum(groups) - groups) * group - (np.cumsum(size) - size), size)] = at
        out = row_sums(table, np.ascontiguousarray(room.reshape(-1, group).T))
        if len(out) == len(size):
            return out
        table, at, size = np.vstack([out, np.zeros((1, out.shape[1]), out.dtype)]), np.arange(len(out)), groups


def shares(s: np.ndarray, p: np.ndarray, idf: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, their rows of A'Ax) of the passages whose words have slots s and passage numbers p, which ascend. rows: x by idf, then zeros."""
    begin = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    size = np.diff(begin, append=len(p))
    y = segment_sums(rows, s, size, FIT)
    # Passages count alike, whatever their words weigh.
    y /= np.maximum(np.add.reduceat(idf[s] ** 2, begin), 1e-6)[:, None]
    order = by_slot(s)
    own = s[order]
    at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    passage = np.repeat(np.arange(len(begin)), size)
    out = segment_sums(np.vstack([y, np.zeros((1, y.shape[1]), y.dtype)]), passage[order], np.diff(at, append=len(own)))
    return own[at], out * idf[own[at]][:, None]


def fit(docs: DataFrame) -> Space:
    """The latent space, from all passages of all distinct texts."""
    spark = docs.sparkSession
    small_batches(spark)
    idf, many = idf_of(docs)
    texts = docs.select(F.col("text").cast("string").alias("text")).distinct().coalesce(max(FIT_TASKS, many // FIT_PASSAGES))
    x = np.random.default_rng(5).normal(size=(1 << BITS, RANK + OVER)).astype(np.float32)
    shared = spark.sparkContext.broadcast((idf, np.vstack([x * idf[:, None], np.zeros((1, RANK + OVER), np.float32)])))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, rows = shared.value
        total = np.zeros((1 << BITS, RANK + OVER), np.float32)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        words_held = last = 0

        def add() -> None:
            slots, own = shares(np.concatenate([s for s, _ in held]), np.concatenate([p for _, p in held]), weight, rows)
            total[slots] += own

        for _, _, _, w in runs(batches):
            if not len((w := once(w)).hash):
                continue
            p = passages(w, FIT) + last
            held.append((slot(w.hash), p))
            words_held, last = words_held + len(p), int(p[-1]) + 1
            if words_held >= HELD:
                add()
                held, words_held = [], 0
        if held:
            add()
        yield from emit_array(total)

    z = summed_array(texts.mapInArrow(lean(run), "part int, blob binary"), (1 << BITS, RANK + OVER), np.float32).astype(np.float64)
    return space(idf, x.astype(np.float64), z)


def space(idf: np.ndarray, x: np.ndarray, z: np.ndarray) -> Space:
    """From the random matrix x and z = A'Ax: right singular vectors of A by Nystrom's formula, each scaled to variance one."""
    q, _ = np.linalg.qr(z)
    core = np.linalg.lstsq((q.T @ x).T, (q.T @ z).T, rcond=None)[0].T
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    top = np.argsort(values)[::-1][:RANK]
    values = np.maximum(values[top], values.max() * 1e-6 + 1e-12)
    return Space(idf, ((q @ vectors[:, top]) / np.sqrt(values) * idf[:, None]).astype(np.float32))


@dataclass
class Item:
    """words and answer: hashes; size: of its windows, in words; told: whether the item states its answer."""

    item_id: object
    words: np.ndarray
    answer: np.ndarray
    size: int
    told: bool = False

    def __post_init__(self) -> None:
        self.known = frozenset(self.words.tolist())

    def pieces(self) -> list[tuple[int, np.ndarray]]:
        """(place in the item, words) of what is searched: the item, or pieces of the longest window's length that cover it."""
        n, size = len(self.words), LENGTHS[-1]
        if 4 * n <= 5 * size:
            return [(0, self.words)]
        return [(a, self.words[a : a + size]) for a in sorted({*range(0, n - size, size), n - size})]


def hashes(text: str) -> np.ndarray:
    return words(*folded(pa.array([text], pa.string())), ALNUM).hash


def window_for(n: int) -> int:
    """The length of an item's windows: of all lengths the shortest that holds four fifths of it."""
    return next((size for size in LENGTHS if 5 * size >= 4 * n), LENGTHS[-1])


def step_of(size: int) -> int:
    """Words between windows: a third or a quarter of a window, whichever is a power of two."""
    return size // 3 if size % 3 == 0 else size // 4


def item(item_id: object, text: str | None) -> Item | None:
    h = hashes(text or "")
    if not len(h):
        return None
    told = regex.search(r"(?i)\banswer\s*:\s*(.+)", text, regex.S)
    last = told[1] if told else ([s for s in regex.split(r"(?<=[.!?])\s+|\n", text) if len(hashes(s)) >= 3] or [text])[-1]
    answer = hashes(last)
    return Item(item_id, h, answer if len(answer) else h, window_for(len(h)), bool(told and len(answer)))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    g = h[: len(h) - k + 1] * _STEP[0]
    for j in range(1, k):
        g += h[j : len(h) - k + 1 + j] * _STEP[j]
    return mix(g)


def embed(h: np.ndarray, s: Space) -> np.ndarray:
    v = s.table[slot(h[first_of_runs(h)])].sum(0)
    return v / max(float(np.linalg.norm(v)), 1e-9)


def lcs(a: np.ndarray, b: list[int]) -> int:
    """Length of the longest common subsequence, with the positions in a as bits of one number."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        m = where.get(x)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@dataclass
class Searcher:
    """A block of items, by the length of their windows, in a latent space."""

    space: Space
    items: list[Item]

    def __post_init__(self) -> None:
        self.table = np.vstack([self.space.table, np.zeros((1, self.space.table.shape[1]), np.float32)])
        self.by_size = []
        for size in sorted({i.size for i in self.items}):
            own = [(i, a, h) for i in self.items if i.size == size for a, h in i.pieces()]
            self.by_size.append((size, [(i, a) for i, a, _ in own], np.stack([embed(h, self.space) for _, _, h in own]).astype(np.float32)))
        self.by_start: dict[int, dict[int, list[Item]]] = {}
        for i in self.items:
            k = max(k for k in STARTS if k <= len(i.words))
            self.by_start.setdefault(k, {}).setdefault(int(grams(i.words[:k], k)[0]), []).append(i)
        self.starts = {k: np.array(sorted(v), np.uint64) for k, v in self.by_start.items()}
        self.begins = {k: np.bincount((v >> U(48)).astype(np.int64), minlength=1 << 16) > 0 for k, v in self.starts.items()}

    def copies(self, w: Words, found: list[dict[object, tuple[float, float, float]]]) -> None:
        """Add the items whose words stand in a document without a gap."""
        for k, starts in self.starts.items():
            if len(w.hash) < k:
                continue
            g = grams(w.hash, k)
            at = np.flatnonzero(self.begins[k][(g >> U(48)).astype(np.int64)])  # few pass, so few are looked for
            at = at[starts[np.searchsorted(starts, g[at]).clip(0, len(starts) - 1)] == g[at]]
            for i, d in zip(at.tolist(), (np.searchsorted(w.bounds, at, "right") - 1).tolist(), strict=True):
                for x in self.by_start[k][int(g[i])]:
                    if x.item_id not in found[d] and i + len(x.words) <= w.bounds[d + 1] and (w.hash[i : i + len(x.words)] == x.words).all():
                        found[d][x.item_id] = (1.0, 1.0, 1.0)

    def blocks(self, w: Words, begin: np.ndarray, n: np.ndarray, step: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(sums of the vectors of each `step` words, first such block of each piece). Pieces: n words from word `begin`.

        Pieces end in words without a vector: up to a multiple of `most` words, and then three times as many, so that no
        window reaches into the next piece.
        """
        room = np.where(n > 0, (-(-n // most) + 3) * most, 0)
        first = np.concatenate([[0], np.cumsum(room)])
        at = np.full(int(first[-1]), 1 << BITS, np.int64)  # the row of zeros
        own = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        word = own + np.repeat(begin, n)
        again = (w.hash[word] == w.hash[word - 1]) & (own > 0)  # word 0 has none before it
        at[own + np.repeat(first[:-1], n)] = np.where(again, 1 << BITS, slot(w.hash[word]))
        return row_sums(self.table, np.ascontiguousarray(at.reshape(-1, step).T)), first // step

    def run(self, w: Words) -> list[dict[object, tuple[float, float, float]]]:
        """For each document, item_id: (cosine, LCS's share of the item, of its answer), of its best match."""
        found: list[dict[object, tuple[float, float, float]]] = [{} for _ in range(len(w.bounds) - 1)]
        if not len(w.hash) or not self.items:
            return found
        self.copies(w, found)
        done: set[tuple[int, int, int]] = set()
        for docs, begin, n in pieces_of(w.bounds):
            self.windows(w, found, done, docs, begin, n)
        return found

    def windows(self, w: Words, found: list[dict], done: set[tuple[int, int, int]], docs: np.ndarray, begin: np.ndarray, n: np.ndarray) -> None:
        """Add what is near an item in pieces of documents: piece i has n[i] words of document docs[i] from word begin[i]."""
        own = step_of(self.by_size[0][0])
        sums, first = self.blocks(w, begin, n, own, step_of(self.by_size[-1][0]))
        for size, items, table in self.by_size:
            step = step_of(size)
            while own < step:  # steps are powers of two: blocks join in pairs
                sums, first, own = sums[0::2] + sums[1::2], first // 2, own * 2
            v = sums[: len(sums) - 2] + sums[1 : len(sums) - 1]
            v += sums[2:]
            if size // step == 4:
                v = v[:-1]
                v += sums[3:]
            turn = max(256, (1 << 22) // len(items))
            for a in range(0, len(v), turn):
                part = v[a : a + turn]
                norm = np.sqrt(np.einsum("ij,ij->i", part, part))
                cos = part @ table.T
                at, which = np.divmod(np.flatnonzero(cos > COSINE * np.maximum(norm, 1e-9)[:, None]), len(items))
                piece = np.searchsorted(first, a + at, "right") - 1
                for i, k, q in zip(at.tolist(), which.tolist(), piece.tolist(), strict=True):
                    d, place = int(docs[q]), int(begin[q]) + (a + i - int(first[q])) * step
                    x, offset = items[k]
                    if 4 * len(x.words) <= 5 * LENGTHS[-1]:
                        self.check(found[d], x, w, place, d, float(cos[i, k] / norm[i]))
                        continue
                    grid = len(x.words) // 8  # pieces and windows of one place are checked together
                    place = (place - offset) // grid * grid
                    if (d, id(x), place) not in done:
                        done.add((d, id(x), place))
                        self.check(found[d], x, w, place, d, float(cos[i, k] / norm[i]), grid)

    def check(self, found: dict[object, tuple[float, float, float]], x: Item, w: Words, begin: int, doc: int, cos: float, more: int = 0) -> None:
        if x.item_id in found and found[x.item_id][1] == 1.0:
            return
        reach = max(len(x.words), x.size) // 2 + more
        lo, hi = max(int(w.bounds[doc]), begin - reach), min(int(w.bounds[doc + 1]), begin + max(len(x.words), x.size) + reach)
        h = w.hash[lo:hi].tolist()
        if len(x.known.intersection(h)) < LCS * len(x.known) - (len(x.words) - len(x.known)):  # the subsequence cannot be long enough
            return
        share = lcs(x.words, h) / len(x.words)
        if share < LCS:
            return
        answer = lcs(x.answer, h) / len(x.answer)
        if x.told and answer < ANSWER:
            return
        if x.item_id not in found or found[x.item_id][1] < share:
            found[x.item_id] = (min(1.0, cos), share, answer)


def pieces_of(bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, first word, words) of pieces of documents, some PIECE words at a time. A piece overlaps the next by the longest window."""
    size = np.diff(bounds)
    many = -(-size // PIECE)
    docs = np.repeat(np.arange(len(size)), many)
    at = (np.arange(len(docs)) - np.repeat(np.cumsum(many) - many, many)) * PIECE
    n = np.minimum(PIECE + LENGTHS[-1], size[docs] - at)
    group = (np.cumsum(n) - n) // (2 * PIECE)
    for k in np.split(np.arange(len(docs)), np.flatnonzero(np.diff(group)) + 1):
        yield docs[k], bounds[docs[k]] + at[k], n[k]


def blocks(benchmark: DataFrame, items: int = ITEMS, most: int = ITEM_BYTES) -> Iterator[list[Item]]:
    """The items, in blocks of about `items` items and `most` bytes, each of which the driver holds by itself."""
    n, size = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()
    parts = max(-(-n // items), -(-size // most))
    for k in range(parts):
        rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        if own := [x for r in sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"], r["text"] or "")) if (x := item(r["item_id"], r["text"]))]:
            yield own


def search(docs: DataFrame, benchmark: DataFrame, latent: Space | None = None) -> DataFrame:
    """doc_id, item_id, cosine, lcs and answer for each pair of a document and a benchmark item that it holds."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ids = (docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType)
    kind = f"doc_id {ids[0].simpleString()}, item_id {ids[1].simpleString()}, cosine double, lcs double, answer double"
    kinds = (*map(to_arrow_type, ids), pa.float64(), pa.float64(), pa.float64())
    out = None
    for own in blocks(benchmark):
        latent = latent or fit(docs)
        shared = spark.sparkContext.broadcast(Searcher(latent, own))  # a block of items

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b, i, j, w in runs(batches):
                ids = b["doc_id"].slice(i, j - i).to_pylist()
                got = [(d, k, *v) for d, f in zip(ids, shared.value.run(w), strict=True) for k, v in sorted(f.items(), key=lambda x: (x[0] is None, x[0]))]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "cosine", "lcs", "answer"])

        part = rows.mapInArrow(lean(run), kind)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], kind)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, latent: Space | None = None) -> DataFrame:
    """The documents that hold no benchmark item, with the columns they came with, whatever their names."""
    spark = docs.sparkSession
    small_batches(spark)
    places = [f"k{i}" for i in range(len(docs.columns))]
    text = places[docs.columns.index("text")]
    out = docs.select(*(col(c).alias(k) for c, k in zip(docs.columns, places, strict=True)))
    for own in blocks(benchmark):
        latent = latent or fit(docs)
        shared = spark.sparkContext.broadcast(Searcher(latent, own))  # a block of items

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b, i, j, w in runs(batches, text):
                clean = pa.array([not f for f in shared.value.run(w)], pa.bool_())
                yield b.slice(i, j - i).filter(clean)

        out = out.mapInArrow(lean(run), out.schema)
    return out.select(*(F.col(k).alias(c) for c, k in zip(docs.columns, places, strict=True)))
