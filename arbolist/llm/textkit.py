"""Vectorised text kernels: hashes of the words of a whole Arrow batch with a few numpy passes over its bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes handled at once; a longer text makes a slice of its own.
SLICE = 1 << 21
#: Bytes of words that are added up place by place.
LONG = 24

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)

#: White space of the word definition: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes of words proper: ASCII letters and digits, and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every bit of a 64-bit hash over all bits."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


_place = np.zeros(0, np.uint64)


def place_table(n: int) -> np.ndarray:
    """An odd multiplier for each of at least n places in a word, each drawn by itself, so that words of any length hash apart."""
    global _place
    if len(_place) >= n:
        return _place
    out = mix((np.arange(max(n, 4096), dtype=np.uint64) + U(1)) * U(0x9E3779B97F4A7C15)) | U(1)
    if n <= 1 << 20:
        _place = out
    return out


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its texts; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> list[tuple[int, int]]:
    """Runs of whole texts of at most `most` bytes, or of one longer text."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        out.append((a, b))
        a = b
    return out


@dataclass
class Words:
    """Words of a run of texts: first and end byte, hash, and the place of each text's words (bounds[i]:bounds[i+1])."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold_case: bool = True) -> Words:
    """The maximal runs of bytes for which `inside` is true, within each text. Offsets start at 0.

    A long run of texts is taken in pieces that end between words, so that what is held beside the words is bounded.
    """
    n = len(raw)
    if n <= 2 * SLICE:
        return _words(raw, offsets, inside, fold_case)
    parts, a = [], 0
    while a < n:
        b = a + SLICE
        while b < n and inside[raw[b - 1]] and inside[raw[b]] and len(stop := np.flatnonzero(~inside[raw[b : b + SLICE]])) == 0:
            b += SLICE
        if b < n and inside[raw[b - 1]] and inside[raw[b]]:
            b += int(stop[0])
        b = min(b, n)
        cut = offsets[(offsets > a) & (offsets < b)] - a
        w = _words(raw[a:b], np.concatenate([[0], cut, [b - a]]), inside, fold_case)
        parts.append((w.start + a, w.end + a, w.hash))
        a = b
    start, end, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Words(start, end, h, np.searchsorted(start, offsets))


def sums_of(raw: np.ndarray, start: np.ndarray, size: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each word the sum of its bytes' numbers, each times its place's: first bytes of all words, then second ones, and so on."""
    out = np.empty(len(start), np.uint64)
    order = np.argsort(np.minimum(size, LONG + 1).astype(np.uint8), kind="stable")[::-1]  # short integers are sorted by radix
    many = len(order) - np.searchsorted(size[order[::-1]].clip(max=LONG + 1), np.arange(LONG + 2), "right")
    at, own, place = start[order], np.zeros(len(order), np.uint64), place_table(LONG)
    now = at.copy()
    for k in range(LONG):
        if not many[k]:
            break
        own[: many[k]] += (table * place[k]).take(raw.take(now[: many[k]]))
        now[: many[k]] += 1
    if many[LONG]:  # longer words: all their bytes at once
        far = size[order[: many[LONG]]]
        begin = np.cumsum(far) - far
        nth = np.arange(int(far.sum())) - np.repeat(begin, far)
        own[: many[LONG]] = np.add.reduceat(table[raw[np.repeat(at[: many[LONG]], far) + nth]] * place_table(int(far.max()))[nth], begin)
    out[order] = own
    return out


def _words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold_case: bool) -> Words:
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    w = np.frombuffer(raw.tobytes().translate(inside.tobytes()), bool)
    edge = np.flatnonzero(w[1:] != w[:-1]) + 1
    edge = np.concatenate([np.zeros(int(w[0]), np.int64), edge, np.full(int(w[-1]), n)])
    start, end = edge[0::2], edge[1::2]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = np.unique(cut[w[cut] & w[cut - 1]])  # texts that end and begin within a run
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    if not len(start):
        return Words(start, end, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    table = np.where(inside, _BYTE[LOWER] if fold_case else _BYTE, U(0))
    size = end - start
    h = mix(sums_of(raw, start, size, table) + U(0x9E3779B97F4A7C15) * size.astype(np.uint64))
    return Words(start, end, h, np.searchsorted(start, offsets))


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, and bounds; a text of 1 to k-1 words has its whole sequence as one."""
    counts = np.diff(w.bounds)
    n = len(w.hash)
    full = np.maximum(counts - k + 1, 0)
    if n >= k:
        g = w.hash[: n - k + 1] * _STEP[0]
        for j in range(1, k):
            g += w.hash[j : n - k + 1 + j] * _STEP[j]
        g = mix(g)
        doc = w.doc()
        g = g[doc[: n - k + 1] == doc[k - 1 :]]
    else:
        g = np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        at = np.cumsum(full)[short]
        own = []
        for i in short:
            h = w.hash[w.bounds[i] : w.bounds[i + 1]]
            own.append(int(mix(np.array([np.add.reduce(h * _STEP[8 : 8 + len(h)]) + U(len(h))], np.uint64))[0]))
        g = np.insert(g, at, np.array(own, np.uint64))
        full[short] = 1
    return g, np.concatenate([[0], np.cumsum(full)])
