"""The batch parser: a column of expression texts to node structs, with a few numpy passes over the bytes of an Arrow batch.

Tokens are found by masks, elements are matched with their lists by sorting on depth, and keys are gathered token by token
with single spaces. Rows with comments, escapes, line ends within strings, or anything that is no expression are left to the
plain parser (functions.sexp), which knows the errors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import sexp as S

NODE = pa.struct([("id", pa.int32()), ("c", pa.list_(pa.int32())), ("last", pa.int32()), ("t", pa.string()), ("ks", pa.int32()), ("kl", pa.int32()), ("ts", pa.int32()), ("tl", pa.int32())])
VALUE = pa.struct([("key", pa.string()), ("txt", pa.string()), ("nodes", pa.list_(NODE))])
KINDS = pa.array(["list", "nil", "symbol", "string", "integer", "float"])
LIST, NIL, SYMBOL, STRING, INTEGER, FLOAT = range(6)
#: Bytes handled at once; a longer text makes a slice of its own.
SLICE = 1 << 21


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SPACE, CONTROL, DIGIT, SIGN = _set(b" \t\n\v\f\r"), _set(b"\t\n\r"), _set(b"0123456789"), _set(b"+-")


def parse_column(texts: pa.Array, strict: bool = True) -> pa.Array:
    """VALUE structs; null for null, and for what is no expression unless strict (then an error)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    known = texts.is_valid().to_numpy(zero_copy_only=False)
    plain = texts.fill_null("") if texts.null_count else texts
    _, offsets, data = plain.buffers()
    off = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(plain.type) else np.int32)[plain.offset : plain.offset + len(plain) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    parts, a = [], 0
    while a < len(plain):
        b = max(a + 1, int(np.searchsorted(off, off[a] + SLICE, "right")) - 1)
        parts.append(_slice(raw[off[a] : off[b]], off[a : b + 1] - off[a], known[a:b], texts.slice(a, b - a), strict))
        a = b
    return pa.concat_arrays(parts) if parts else pa.array([], VALUE)


def _slice(raw: np.ndarray, off: np.ndarray, known: np.ndarray, texts: pa.Array, strict: bool) -> pa.Array:
    good, fast = _fast(raw, off, known)
    if good.all():
        return fast
    parse = S.parse if strict else S.try_parse
    rest = pa.array([S.value(parse(t)) if t is not None else None for t in texts.filter(pa.array(~good)).to_pylist()], VALUE)
    place = np.empty(len(good), np.int64)
    place[good], place[~good] = np.arange(good.sum()), good.sum() + np.arange((~good).sum())
    return pa.concat_arrays([fast, rest]).take(pa.array(place))


def _fast(raw: np.ndarray, off: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(which rows are parsed here, their VALUE structs)."""
    rows, n = len(off) - 1, len(raw)
    row_of = lambda at: np.searchsorted(off, at, "right") - 1
    good = known.copy()
    quote = raw == 34
    count = np.concatenate([[0], np.cumsum(quote)])
    odd = ((count[1:] - np.repeat(count[off[:-1]], np.diff(off))) & 1).astype(bool)
    inside = odd | quote  # of a string, with its quotes
    bad = (raw == 59) & ~inside | inside & ((raw == 92) | CONTROL[raw])
    good[row_of(np.flatnonzero(bad))] = False
    good[(count[off[1:]] - count[off[:-1]]) & 1 == 1] = False

    # Tokens in order: where each begins and ends. kind: 1 open, 2 close, 3 string, 4 other atom.
    begin = np.zeros(n, np.uint8)
    out = ~inside
    begin[(raw == 40) & out] = 1
    begin[(raw == 41) & out] = 2
    begin[quote & odd] = 3
    word = out & (raw != 40) & (raw != 41) & ~SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
    first[cut] = word[cut]
    begin[first] = 4
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[cut - 1] = word[cut - 1]
    start = np.flatnonzero(begin)
    kind = begin[start]
    end = start + 1
    end[kind == 4] = np.flatnonzero(last) + 1
    # A string that a row leaves open ends with the row; the row is none of ours.
    closing = np.flatnonzero(quote & ~odd)
    if (strings := kind == 3).any():
        at = np.searchsorted(closing, start[strings])
        end[strings] = np.append(closing, n)[at.clip(0, len(closing))] + 1
    row = row_of(start)
    keep = good[row]
    start, end, kind, row = start[keep], end[keep], kind[keep], row[keep]

    # Depth after each token; rows must be one whole value.
    step = (kind == 1).astype(np.int64) - (kind == 2)
    total = np.cumsum(step)
    bounds = np.searchsorted(row, np.arange(rows + 1))
    depth = total - np.append(0, total)[bounds[row]]
    some = np.diff(bounds) > 0
    whole = np.zeros(rows, bool)
    if len(row):
        at = bounds[:-1][some]
        roots = ((kind == 1) & (depth == 1) | (kind >= 3) & (depth == 0)).astype(np.int64)
        whole[some] = (np.add.reduceat(roots, at) == 1) & (np.minimum.reduceat(depth, at) >= 0) & (np.maximum.reduceat(depth, at) < S.MAX_DEPTH) & (depth[bounds[1:][some] - 1] == 0)
    good &= whole
    keep = good[row]
    start, end, kind, row, depth = start[keep], end[keep], kind[keep], row[keep], depth[keep]
    m = len(row)
    if not m:
        return good, pa.array([None] * int(good.sum()), VALUE)
    row = (np.cumsum(good) - 1)[row]
    rows = int(good.sum())
    bounds = np.searchsorted(row, np.arange(rows + 1))

    # Types of atoms, and what stands in keys and texts in place of those that are not written so.
    size = end - start
    digits = np.concatenate([[0], np.cumsum(DIGIT[raw])])
    points = np.concatenate([[0], np.cumsum(raw == 46)])
    digit, point, sign = digits[end] - digits[start], points[end] - points[start], SIGN[raw[start]]
    t = np.full(m, SYMBOL, np.int8)
    t[kind == 3] = STRING
    atom = kind == 4
    whole_number = atom & (digit > 0) & (digit + sign == size)
    t[whole_number] = INTEGER
    t[atom & (digit > 0) & (point == 1) & (digit + sign + 1 == size)] = FLOAT
    three = np.flatnonzero(atom & (size == 3))
    nil = three[(raw[start[three]] == 110) & (raw[start[three] + 1] == 105) & (raw[start[three] + 2] == 108)]
    t[nil] = NIL
    t[kind == 1] = LIST
    follows_open = np.concatenate([[False], kind[:-1] == 1])
    t[np.flatnonzero((kind == 2) & follows_open) - 1] = NIL
    lead = raw[np.minimum(start + sign, n - 1)] == 48
    other = np.flatnonzero(whole_number & ((raw[start] == 43) | lead & ((digit > 1) | sign) | (digit > 18)) | (t == FLOAT))
    forms = [S.atom(raw[start[i] : end[i]].tobytes().decode("utf-8", "replace")) for i in other]
    put = {int(i): b"()" for i in nil} | {int(i): f.key.encode() for i, f in zip(other, forms, strict=True)}
    shown = {int(i): f.txt.encode() for i, f in zip(other, forms, strict=True) if f.t == "float"}

    # Nodes and their lists.
    node = kind != 2
    index = np.cumsum(node) - 1
    row_first = index[bounds[:-1]]
    own = (index - row_first[row]).astype(np.int32)
    opens, closes = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
    paired = np.concatenate([opens, closes])
    level = np.concatenate([depth[opens], depth[closes] + 1])
    order = np.lexsort((paired, level))
    close_of = np.zeros(m, np.int64)
    close_of[paired[order[0::2]]] = paired[order[1::2]]
    tail = own.copy()
    tail[opens] = own[close_of[opens]]  # a close has the number of the node before it
    nodes = np.flatnonzero(node)
    around = depth[nodes] - (kind[nodes] == 1)
    inner = nodes[around >= 1]
    marks = np.sort(depth[opens] * m + opens)
    parent = marks[np.searchsorted(marks, around[around >= 1] * m + inner) - 1] % m if len(inner) else inner
    alone = nodes[kind[nodes] >= 3]
    alone = alone[t[alone] != NIL]
    owner = np.concatenate([index[parent], index[alone]])
    child = np.concatenate([own[inner], own[alone]])[np.argsort(owner, kind="stable")]
    child_off = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(nodes)))])

    key, key_off, ks, kl = _gather(raw, start, end, kind, row, rows, bounds, close_of, put)
    texts = pa.array([None] * rows, pa.string())
    ts = tl = pa.nulls(len(nodes), pa.int32())
    if shown:
        floats = np.bincount(row[t == FLOAT], minlength=rows) > 0
        txt, txt_off, ts, tl = _gather(raw, start, end, kind, row, rows, bounds, close_of, put | shown)
        texts = pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(txt_off), pa.py_buffer(txt)]).cast(pa.string())
        texts = pc.if_else(pa.array(floats), texts, None)
        mask = ~floats[row[nodes]]
        ts, tl = pa.array(ts[nodes], mask=mask), pa.array(tl[nodes], mask=mask)
    keys = pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(key_off), pa.py_buffer(key)]).cast(pa.string())
    structs = pa.StructArray.from_arrays(
        [pa.array(own[nodes]), pa.ListArray.from_arrays(pa.array(child_off, pa.int32()), pa.array(child, pa.int32())), pa.array(tail[nodes]), KINDS.take(pa.array(t[nodes])), pa.array(ks[nodes]), pa.array(kl[nodes]), ts, tl],
        fields=list(NODE),
    )
    lists = pa.ListArray.from_arrays(pa.array(np.append(row_first, len(nodes)), pa.int32()), structs)
    return good, pa.StructArray.from_arrays([keys, texts, lists], fields=list(VALUE))


def _gather(raw: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray, row: np.ndarray, rows: int, bounds: np.ndarray, close_of: np.ndarray, put: dict[int, bytes]) -> tuple[np.ndarray, ...]:
    """(bytes, row offsets, first character and characters of each token's value): tokens with single spaces, some replaced."""
    size, source = end - start, start.copy()
    if put:
        at = np.fromiter(put, np.int64, len(put))
        own = list(put.values())
        size[at] = [len(x) for x in own]
        source[at] = len(raw) + np.cumsum(size[at]) - size[at]
        raw = np.concatenate([raw, np.frombuffer(b"".join(own), np.uint8)])
    spaced = kind != 2
    spaced[1:] &= kind[:-1] != 1
    spaced[bounds[:-1]] = False
    ends = np.cumsum(size + spaced)
    begins = ends - size
    out = np.full(int(ends[-1]), 32, np.uint8)
    run = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[run + np.repeat(begins, size)] = raw[run + np.repeat(source, size)]
    row_off = np.append(0, ends)[bounds]
    stop = ends.copy()
    opens = np.flatnonzero(kind == 1)
    stop[opens] = ends[close_of[opens]]
    if (out & 0x80).any():
        points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
        return out, row_off, (points[begins] - points[row_off[row]]).astype(np.int32), (points[stop] - points[begins]).astype(np.int32)
    return out, row_off, (begins - row_off[row]).astype(np.int32), (stop - begins).astype(np.int32)
