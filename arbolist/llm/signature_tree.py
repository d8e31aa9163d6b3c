"""Jaccard self-join of word shingles by signature trees, and the components that its links make.

Sets. A document's set is the hashes of its distinct five-word shingles. Equal sets are one node, known by 64 bits of hash; a
second hash of 64 bits tells apart sets that share the first.

Cells. Two sets whose Jaccard similarity is at least 80 % share one of the first n - ceil(0.8 n) + 1 shingles of each, in any
one order of all shingles. The order here is rarest first, by a sketch of SKETCH counters that is counted over all documents
(counting errors cost time, never links). The nodes that have a shingle in this prefix are the shingle's cell. A task first
gathers its own nodes of a cell in one row, so that copies and near copies are few rows; shingles of more than HOT sets are
met by aggregation instead of in one task.

Blocks. The rows of all cells, in the order of cell, component and size, are dealt out by ranges and cut into blocks of some
CELL rows, so a cell of any size is as many blocks as it needs, and no task holds it whole.

Trees. A node has a bitmap of about 4 bits for each shingle and its size. In a block, a cell's nodes are sorted and made
leaves, and leaves the nodes of a tree, which hold their members' bitmaps combined by OR, their range of sizes, and the
greatest number of shingles that fall on a bit already set. Of two tree nodes the overlap of any two members is at most

    min(greatest sizes, surplus + bits that both have)

and what this bound and the sizes leave is traversed down to pairs of sets. Of a cell that lies in several blocks, tree nodes
of GRANULE sets are sent as summaries, and neighbours of one component joined to one; only granules that the bound leaves are
brought together. Members of one component need no comparison, and a node, or a component of a large cell, that has enough
partners waits for the next round (with more partners allowed), when many members have become one component: so a cell of
near copies costs rows in proportion to its members, not their pairs. Cells end when nothing waits.

Links. Pairs that are left are compared exactly, on sets that are taken from the texts once, for nodes with any partner.
Components of all links come from repeated contraction. No pair with the similarity is lost at any step. (Shingles are
compared by 64-bit hashes: two that differ and hash alike within one pair of sets would count as one.)

Defined results: null text and text without a word have an empty set, are linked with nothing and are components of their
own; rows that repeat an id are linked only if their texts are; a component is named by its smallest id (null ids only: null).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, drop_dir, emit_array, lean, shared_dir, small_batches, summed_array, written
from .components import components
from .textkit import SPACE, U, mix, shingles, slices, text_bytes, words

SKETCH_BITS = 20
LEAF = 16
#: Rows of a block, about; rows of a granule; rows that are cut into blocks in one task, about.
CELL, GRANULE, RANGE = 4096, 256, 1 << 21
#: Sets that share a shingle, beyond which the shingle's cell is gathered by aggregation.
HOT = 1 << 20
#: Rows (of one to three numbers of 8 bytes) that may be broadcast.
FEW = 1_000_000
PERCENT = 80


def few(rows: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be joined: of at most FEW rows it is broadcast, so that what it meets is not shuffled for it."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def sets(col: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw, off = text_bytes(col)
    for i, j in slices(off):
        g, bounds = shingles(words(raw[off[i] : off[j]], off[i : j + 1] - off[i], ~SPACE), k)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.unique(g[a:b])


def names_of(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, each of all its elements (0, 0: the empty set)."""
    if not len(s):
        return 0, 0
    sums = np.array([np.add.reduce(mix(s + U(1))) + U(len(s)), np.add.reduce(mix(s * U(0x9E3779B97F4A7C15) + U(5))) ^ U(len(s))], np.uint64)
    a, b = (mix(sums) | U(1)).view(np.int64).tolist()
    return a, b


def prefix_size(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def bitmap(s: np.ndarray) -> np.ndarray:
    """Bits of a set: a power of two of at least 4 bits an element, of which at least 64, as 64-bit words."""
    bits = 1 << max(6, int(4 * len(s) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(mix(s) >> U(64 - (bits.bit_length() - 1))).astype(np.int64)] = 1
    return np.packbits(out).view(np.uint64)


def sketch(docs: DataFrame) -> np.ndarray:
    """How many sets have a shingle, roughly: counters by hash, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int32)
        for b in batches:
            for part in _joined(sets(b["text"])):
                total += np.bincount((part >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total)).astype(np.int32)
        yield from emit_array(total)

    return summed_array(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "part int, blob binary"), (1 << SKETCH_BITS,), np.int32)


def _joined(parts: Iterator[np.ndarray], most: int = 1 << 20) -> Iterator[np.ndarray]:
    held, size = [], 0
    for p in parts:
        held.append(p)
        size += len(p)
        if size >= most:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def nodes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """doc_id, n, node and other (hashes of the set), bits, and prefix (hashes of its first shingles, as bytes) for each document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(counts)  # 2 ** SKETCH_BITS counters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, names, bits, prefix = [], [], [], []
            for s in sets(b["text"]):
                n.append(len(s))
                names.append(names_of(s))
                bits.append(bitmap(s).tobytes())
                p = prefix_size(len(s)) if len(s) else 0
                order = np.lexsort((s, shared.value[(s >> U(64 - SKETCH_BITS)).astype(np.int64)]))[:p]
                prefix.append(s[order].tobytes())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array([x for x, _ in names], pa.int64()), pa.array([x for _, x in names], pa.int64()), pa.array(bits, pa.binary()), pa.array(prefix, pa.binary())], names=["doc_id", "n", "node", "other", "bits", "prefix"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id {dict(rows.dtypes)['doc_id']}, n long, node long, other long, bits binary, prefix binary")


def told_apart(rows: DataFrame) -> DataFrame:
    """rows with other nodes for sets that share a node's hash but not the second one, and `name`, what the node was."""
    clash = rows.groupBy("node").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi").select(F.col("node").alias("name"))
    own = rows.withColumn("name", F.col("node"))
    if clash.isEmpty():
        return own
    again = clash.withColumn("again", F.lit(True))
    return own.join(again, "name", "left").withColumn("node", F.when(F.col("again"), F.xxhash64("node", "other")).otherwise(F.col("node"))).drop("again")


def cells(rows: DataFrame, parts: int, counts: np.ndarray) -> DataFrame:
    """(cell, node) for each cell of two nodes or more, by shingle."""
    kind = "part int, token binary, node binary"
    often = np.packbits(counts > HOT)
    shared = rows.sparkSession.sparkContext.broadcast(often)  # 2 ** SKETCH_BITS bits

    def is_hot(t: np.ndarray) -> np.ndarray:
        at = (t >> U(64 - SKETCH_BITS)).astype(np.int64)
        return (shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [(t[h], v) for v, p in zip(b["node"].to_pylist(), b["prefix"].to_pylist(), strict=True) if (h := is_hot(t := np.frombuffer(p, np.uint64))).any()]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([t for t, _ in own]).view(np.int64)), pa.array(np.repeat([v for _, v in own], [len(t) for t, _ in own]))], names=["token", "node"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens and their nodes, without repeats, by part: some million at a time."""
        held, size = [], 0

        def out() -> pa.RecordBatch:
            t, v = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((v, t, t % U(parts)))
            t, v = t[order], v[order]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
            t, v = t[new], v[new]
            part = (t % U(parts)).astype(np.int64)
            cut = np.flatnonzero(np.diff(part)) + 1
            begin = np.concatenate([[0], cut])
            return pa.RecordBatch.from_arrays([pa.array(part[begin], pa.int32()), pa.array([x.tobytes() for x in np.split(t, cut)], pa.binary()), pa.array([x.tobytes() for x in np.split(v, cut)], pa.binary())], names=["part", "token", "node"])

        for b in batches:
            for node, p in zip(b["node"].to_pylist(), b["prefix"].to_pylist(), strict=True):
                t = np.frombuffer(p, np.uint64)
                if often.any():
                    t = t[~is_hot(t)]
                if len(t):
                    held.append((t, np.full(len(t), node, np.int64)))
                    size += len(t)
            if size > 1 << 21:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.frombuffer(t, np.uint64), np.frombuffer(v, np.int64)) for b in batches for t, v in zip(b["token"].to_pylist(), b["node"].to_pylist(), strict=True)]
        if not held:
            return
        t, v = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        order = np.lexsort((v, t))
        t, v = t[order], v[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
        t, v = t[new], v[new]
        begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.diff(np.append(begin, len(t)))
        # Cells with the same nodes are one: shingles that stand together share their nodes.
        if len(begin):
            same = np.add.reduceat(mix(v.view(np.uint64)), begin)
            _, once = np.unique(same + mix(size.astype(np.uint64)), return_index=True)
            own = np.zeros(len(begin), bool)
            own[once] = True
            keep = np.repeat(own & (size > 1), size)
            cell = np.repeat(same, size)[keep].view(np.int64)
            for a in range(0, len(cell), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(cell[a : a + 100_000]), pa.array(v[keep][a : a + 100_000])], names=["cell", "node"])

    own = rows.select("node", "prefix")
    out = own.mapInArrow(lean(gather), kind).repartition(parts, "part").mapInArrow(lean(meet), "cell long, node long")
    if often.any():
        pairs = own.mapInArrow(lean(hot), "token long, node long").distinct()
        same = pairs.groupBy("token").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.count("*").alias("n")).where("n > 1")
        first = same.groupBy("x", "n").agg(F.min("token").alias("token")).select("token")  # cells with the same nodes are one
        out = out.union(pairs.join(first, "token", "left_semi").select(F.xxhash64("token", F.lit(11)).alias("cell"), "node"))
    return out.distinct()


def bound_ok(n1: np.ndarray, x1: np.ndarray, n2: np.ndarray, x2: np.ndarray, low1: np.ndarray, low2: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether tree nodes may have members that link. n: greatest sizes, low: smallest, x: greatest surplus, both: bits that both have.

    Sets of sizes a and b link only if their overlap o has (a + b - o) * PERCENT <= 100 o.
    """
    most = np.minimum(np.minimum(n1, n2), both + np.minimum(x1, x2))
    sizes = (PERCENT * low1 <= 100 * n2) & (PERCENT * low2 <= 100 * n1)
    return sizes & (PERCENT * (low1 + low2) <= (100 + PERCENT) * most)


def traverse(node: np.ndarray, n: np.ndarray, comp: np.ndarray, bits: list[np.ndarray], limit: int, side: np.ndarray | None = None, large: bool = False) -> tuple[np.ndarray, np.ndarray, bool]:
    """(a, b, whether any pair waits): pairs of a cell's nodes that the bounds leave, of different components (and sides, if given).

    A node takes part in more than `limit` pairs only with nodes that have fewer; in large cells, of two components at most
    2 * limit pairs are taken, as one link joins them. What is left so waits.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waits = False
    width = np.array([len(x) for x in bits])
    for w in np.unique(width):
        # Sets that link differ in size by a quarter at most, so in bitmap width by a factor of two at most.
        at = np.flatnonzero((width == w) | (width == 2 * w))
        own = width[at] == w
        if own.sum() == 0 or len(at) < 2:
            continue
        order = np.lexsort((node[at], n[at], comp[at]))
        at, own = at[order], own[order]
        table = np.stack([bits[i] if len(bits[i]) == w else fold(bits[i]) for i in at])
        pop = np.bitwise_count(table).sum(1, dtype=np.int64)
        size = n[at]
        a, b, more = dual(table, size, size - pop, comp[at], own, limit, None if side is None else side[at])
        waits |= more
        if large:
            lo, hi = np.minimum(comp[at[a]], comp[at[b]]), np.maximum(comp[at[a]], comp[at[b]])
            some = running(mix(lo.view(U)) + mix(hi.view(U)) * U(7)) < 2 * limit
            waits |= not some.all()
            a, b = a[some], b[some]
        found.append((node[at[a]], node[at[b]]))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, waits
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return np.minimum(a, b), np.maximum(a, b), waits


def fold(b: np.ndarray) -> np.ndarray:
    """A bitmap at half its width: each bit stands for two neighbours, as for hashes one bit shorter."""
    x = np.unpackbits(b.view(np.uint8)).reshape(-1, 2).max(1)
    return np.packbits(x).view(np.uint64)


def dual(table: np.ndarray, size: np.ndarray, surplus: np.ndarray, comp: np.ndarray, own: np.ndarray, limit: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Dual traversal of the tree over the rows of table, which are sorted by component; at least one of a pair is `own`."""
    levels = [(table, size, size, surplus, comp, comp, np.arange(len(size)), own)]
    while len(levels[-1][1]) > LEAF:
        t, lo, hi, x, c0, c1, _, o = levels[-1]
        cut = np.arange(0, len(lo), LEAF)
        levels.append((np.bitwise_or.reduceat(t, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(x, cut), c0[cut], c1[np.append(cut[1:], len(lo)) - 1], cut, np.logical_or.reduceat(o, cut)))
    degree, waits = np.zeros(len(size), np.int64), False
    out: list[tuple[np.ndarray, np.ndarray]] = []
    top = len(levels) - 1
    k = len(levels[top][1])
    i, j = np.triu_indices(k)
    stack = [(top, i, j)]
    while stack:
        level, i, j = stack.pop()
        if len(i) > 1 << 14:
            half = len(i) // 2
            stack += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
            continue
        t, lo, hi, x, c0, c1, _, o = levels[level]
        one = (c0[i] == c1[i]) & (c0[j] == c1[j]) & (c0[i] == c0[j])  # all of one component
        ok = ~one & (o[i] | o[j])
        if level == 0:
            ok &= i < j
            if side is not None:
                ok &= side[i] != side[j]
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        both = np.bitwise_count(t[i] & t[j]).sum(1, dtype=np.int64)
        ok = bound_ok(hi[i], x[i], hi[j], x[j], lo[i], lo[j], both)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if level:
            n = len(levels[level - 1][1])
            if level == 1:
                # Leaves whose members all have partners enough wait, unless they are neighbours.
                begin = np.arange(0, n, LEAF)
                full = np.minimum.reduceat(degree, begin) >= limit
                wait = full[i] & full[j] & (j > i + 1)
                waits |= bool(wait.any())
                i, j = i[~wait], j[~wait]
            step = np.arange(LEAF)
            a = (i[:, None, None] * LEAF + step[None, :, None]) + 0 * step[None, None, :]
            b = (j[:, None, None] * LEAF + step[None, None, :]) + 0 * step[None, :, None]
            a, b = a.ravel(), b.ravel()
            good = (a < n) & (b < n) & (a <= b)
            a, b = a[good], b[good]
            # Many pairs are taken in turns, so that degrees are known when later ones are looked at.
            turn = 1 << 12
            stack += [(level - 1, a[s : s + turn], b[s : s + turn]) for s in range(0, len(a), turn)][::-1]
        else:
            # In a group of near copies any pair will do: those beyond the limit of both wait.
            rank_a, rank_b = running(i), running(j)
            take = (degree[i] + rank_a < limit) | (degree[j] + rank_b < limit)
            waits |= bool((~take).any())
            i, j = i[take], j[take]
            np.add.at(degree, i, 1)
            np.add.at(degree, j, 1)
            out.append((i, j))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, waits
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    return a, b, waits


def running(v: np.ndarray) -> np.ndarray:
    """How often a value came before, for each place."""
    if not len(v):
        return np.zeros(0, np.int64)
    order = np.argsort(v, kind="stable")
    s = v[order]
    first = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])
    out = np.empty(len(v), np.int64)
    out[order] = np.arange(len(v)) - np.repeat(first, np.diff(np.append(first, len(v))))
    return out


def cut(light: DataFrame, parts: int) -> DataFrame:
    """(block, cell, piece, cut, comp, node): rows of cells, in ranges of their order, as blocks of some CELL rows.

    A piece is a run of a cell in a block; cut: whether the cell may have others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b["cell"].to_numpy(), b["comp"].to_numpy(), b["node"].to_numpy()) for b in batches]
        if not held:
            return
        c, comp, node = (np.concatenate(x) for x in zip(*held, strict=True))
        begin = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        size = np.diff(np.append(begin, len(c)))
        some = size > CELL
        some[[0, -1]] = True
        place = np.arange(len(c)) - np.repeat(begin, size)
        piece = place // CELL
        block = (TaskContext.get().partitionId() << 24) + (np.arange(len(c)) - place % CELL) // CELL
        for a in range(0, len(c), 100_000):
            at = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (block, c, piece, np.repeat(some, size), comp, node)], names=["block", "cell", "piece", "cut", "comp", "node"])

    order = ("cell", "comp", "n", "node")
    return light.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(lean(run), "block long, cell long, piece long, cut boolean, comp long, node long")


SUMMARY = "cell long, a long, b long, gid long, piece long, w int, lo long, hi long, c0 long, c1 long, x long, xh long, bits binary, half binary, nodes binary, sizes binary, comps binary, all binary"


def candidates(blocks: DataFrame, limit: int, parts: int) -> DataFrame:
    """Rows (cell, a, b) for pairs to compare (a = b = 0 for each cell in which pairs wait), and rows of granules for cells of several pieces.

    blocks: block, cell, piece, cut, node, n, comp, bits.
    """
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    schema = pa.schema([pa.field(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]]) for x in SUMMARY.split(", ")])

    def granules(first: int, cell: int, piece: int, node: np.ndarray, n: np.ndarray, comp: np.ndarray, bits: list[np.ndarray]) -> list[dict]:
        """A row for every GRANULE nodes of one bitmap width, in the order of components and sizes."""
        out = []
        width = np.array([len(x) for x in bits])
        order = np.lexsort((node, n, comp, width))
        # Cut where the width changes, and about runs of one component that are not short.
        new = np.concatenate([[True], (width[order][1:] != width[order][:-1]) | (comp[order][1:] != comp[order][:-1])])
        begin = np.flatnonzero(new)
        long = np.diff(np.append(begin, len(order))) >= GRANULE // 4
        wide = np.concatenate([[True], width[order][begin][1:] != width[order][begin][:-1]])
        for own in np.split(order, begin[wide | long | np.concatenate([[False], long[:-1]])][1:]):
            for k in range(0, len(own), GRANULE):
                at = own[k : k + GRANULE]
                table = np.stack([bits[i] for i in at])
                small = np.stack([fold(x) for x in table]) if table.shape[1] > 1 else table
                surplus = lambda t, at=at: int((n[at] - np.bitwise_count(t).sum(1, dtype=np.int64)).max())
                out.append({
                    "cell": cell, "gid": first + len(out), "piece": piece, "w": table.shape[1], "lo": int(n[at].min()), "hi": int(n[at].max()), "c0": int(comp[at[0]]), "c1": int(comp[at[-1]]), "x": surplus(table), "xh": surplus(small),
                    "bits": np.bitwise_or.reduce(table, 0).tobytes(), "half": np.bitwise_or.reduce(small, 0).tobytes(), "nodes": node[at].tobytes(), "sizes": n[at].tobytes(), "comps": comp[at].tobytes(), "all": table.tobytes(),
                })
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        block, many = -1, 0

        def runs(t: pa.Table, last: bool) -> Iterator[pa.Table]:
            nonlocal rest
            b, c, p = (t[x].to_numpy() for x in ("block", "cell", "piece"))
            ends = np.concatenate([[0], np.flatnonzero((c[1:] != c[:-1]) | (b[1:] != b[:-1]) | (p[1:] != p[:-1])) + 1, [len(c)]])
            for x, y in zip(ends[:-1], ends[1:], strict=True):
                if y == len(c) and not last:
                    rest = t.slice(x)
                else:
                    yield t.slice(x, y - x)

        def made(pieces: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
            nonlocal block, many
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            more: list[dict] = []
            for t in pieces:
                cell, own = t["cell"][0].as_py(), [t[x].to_numpy() for x in ("node", "n", "comp")]
                bits = [np.frombuffer(x, np.uint64) for x in t["bits"].to_pylist()]
                a, b, waits = traverse(*own, bits, limit, None, t["cut"][0].as_py())
                if waits:
                    a, b = np.append(a, 0), np.append(b, 0)
                if len(a):
                    out.append((np.full(len(a), cell), a, b))
                if t["cut"][0].as_py():
                    if t["block"][0].as_py() != block:
                        block, many = t["block"][0].as_py(), 0
                    got = granules((block << 14) + many, cell, (block << 14) + t["piece"][0].as_py(), *own, bits)
                    many += len(got)
                    more += got
            if out:
                c, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(a), pa.array(b), *(pa.nulls(len(c), f.type) for f in list(schema)[3:])], names=names)
            for k in range(0, len(more), 64):
                yield pa.RecordBatch.from_pylist(more[k : k + 64], schema)

        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            rest = None
            yield from made(runs(t, False))
        if rest is not None:
            yield from made(runs(rest, True))

    return blocks.repartition(parts, "block").sortWithinPartitions("block", "cell", "piece").mapInArrow(lean(run), SUMMARY)


def granule_pairs(summaries: DataFrame, limit: int, parts: int, all_wait: bool) -> DataFrame:
    """(cell, a, b): granules of different pieces of a cell that the bound leaves (a = b = 0 for each cell in which some wait).

    Neighbours of one component are one for this; each takes part in at most `limit` pairs in a round (with others that do), and
    of two components a few granules do, as one link joins them. In the first round, in which every node is a component of
    its own, all wait.
    """
    few = max(1, limit // 8)

    def of_cell(t: pa.Table) -> tuple[list[tuple[int, int]], bool]:
        if all_wait:
            return [], True
        t = t.sort_by([("w", "ascending"), ("c0", "ascending"), ("c1", "ascending"), ("lo", "ascending"), ("gid", "ascending")])
        w, lo, hi, c0, c1, x, xh, gid, piece = (t[k].to_numpy() for k in ("w", "lo", "hi", "c0", "c1", "x", "xh", "gid", "piece"))
        bits, half = ([np.frombuffer(v, np.uint64) for v in t[k].to_pylist()] for k in ("bits", "half"))
        pure = c0 == c1
        joined = np.concatenate([[False], pure[1:] & pure[:-1] & (c0[1:] == c0[:-1]) & (w[1:] == w[:-1])])
        group = np.cumsum(~joined) - 1
        first = np.flatnonzero(~joined)
        out: list[tuple[int, int]] = []
        waits, degree = False, np.zeros(len(first), np.int64)
        for width in np.unique(w):
            at = np.flatnonzero((w == width) | (w == 2 * width))
            own = w[at] == width
            table = np.stack([bits[i] if o else half[i] for i, o in zip(at, own, strict=True)])
            extra = np.where(own, x[at], xh[at])
            begin = np.flatnonzero(np.concatenate([[True], group[at][1:] != group[at][:-1]]))
            tops, top, low, high, most = group[at][begin], np.bitwise_or.reduceat(table, begin), np.minimum.reduceat(lo[at], begin), np.maximum.reduceat(hi[at], begin), np.maximum.reduceat(extra, begin)
            size = np.diff(np.append(begin, len(at)))

            def near(i, j, t=None, n=None, s=None, z=None):
                return bound_ok(n[i], s[i], n[j], s[j], z[i], z[j], np.bitwise_count(t[i] & t[j]).sum(1, dtype=np.int64))

            for i in range(len(begin)):
                if not own[begin[i]]:
                    continue  # of two wider ones, the wider table decides
                js = np.arange(len(begin))
                js = js[(js > i) | ~own[begin]]
                js = js[~(pure[first[tops[js]]] & pure[first[tops[i]]] & (c0[first[tops[js]]] == c0[first[tops[i]]]))]
                js = js[near(np.full(len(js), i), js, top, high, most, low)] if len(js) else js
                for j in js.tolist():
                    a, b = np.arange(begin[i], begin[i] + size[i]), np.arange(begin[j], begin[j] + size[j])
                    both_pure = pure[first[tops[i]]] and pure[first[tops[j]]]
                    if degree[tops[i]] >= limit and degree[tops[j]] >= limit:
                        waits = True
                        continue
                    taken = 0
                    for k in a.tolist():
                        m = b[near(np.full(len(b), k), b, table, hi[at], extra, lo[at])]
                        m = m[piece[at[m]] != piece[at[k]]]
                        if both_pure and taken + len(m) > few:
                            m, waits = m[: few - taken], True
                        out += [(int(gid[at[k]]), int(gid[at[v]])) for v in m]
                        taken += len(m)
                        if both_pure and waits and taken >= few:
                            break
                    if taken:
                        degree[tops[i]] += 1
                        degree[tops[j]] += 1
        return out, waits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        cell = t["cell"].to_numpy()
        ends = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            own = t.slice(a, b - a)
            if len(set(own["piece"].to_pylist())) > 1:
                pairs, waits = of_cell(own)
                pairs += [(0, 0)] * waits
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([int(cell[a])] * len(pairs), pa.int64()), pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["cell", "a", "b"])

    own = summaries.select("cell", "gid", "piece", "w", "lo", "hi", "c0", "c1", "x", "xh", "bits", "half")
    return own.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(lean(run), "cell long, a long, b long")


def across(pairs: DataFrame, granules: DataFrame, limit: int) -> DataFrame:
    """(cell, a, b) as candidates() gives, from pairs of granules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for r in b.to_pylist():
                own = [np.concatenate([np.frombuffer(r[s][k], np.int64) for s in "xy"]) for k in ("nodes", "sizes", "comps")]
                bits, side = [], []
                for k, s in enumerate("xy"):
                    n = len(r[s]["nodes"]) // 8
                    bits += list(np.frombuffer(r[s]["all"], np.uint64).reshape(n, -1))
                    side += [k] * n
                i, j, waits = traverse(*own, bits, limit, np.array(side), True)
                if waits:
                    i, j = np.append(i, 0), np.append(j, 0)
                if len(i):
                    out.append((np.full(len(i), r["cell"]), i, j))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["cell", "a", "b"])

    load = granules.select("gid", F.struct("nodes", "sizes", "comps", "all").alias("v"))
    two = few(pairs).join(load.select(F.col("gid").alias("a"), F.col("v").alias("x")), "a").join(load.select(F.col("gid").alias("b"), F.col("v").alias("y")), "b")
    return two.select("cell", "x", "y").mapInArrow(lean(run), "cell long, a long, b long")


def join(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id for every document."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or shared_dir(spark)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = sketch(docs)
    parts = max(parts, int(counts.sum(dtype=np.int64) // 5 >> 22))  # a task sorts some million tokens
    rows = told_apart(written(nodes(docs, counts), f"{folder}/nodes"))
    cell = written(cells(rows, parts, counts), f"{folder}/cells")

    # One row for each node in a cell. Copies meet before the shuffle.
    first = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("bits").alias("bits"), F.first("name").alias("name"), F.first("other").alias("other"))
    bits = written(first.join(cell.select("node").distinct(), "node", "left_semi"), f"{folder}/bits")
    links = compared = full = None
    comp, limit, k, took = None, 2, 0, None
    while True:
        own = cell if took is None else cell.join(few(took), "cell", "left_semi")
        place = bits.select("node", "n", F.col("node").alias("comp")) if comp is None else bits.select("node", "n").join(comp, "node", "left").select("node", "n", F.coalesce("comp", "node").alias("comp"))
        light = written(own.join(place, "node").select("cell", "comp", "n", "node"), f"{folder}/light{k}")
        if k:  # cells that have become one component are done
            done = written(light.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo = hi").select("cell"), f"{folder}/done{k}")
            light = light.join(few(done), "cell", "left_anti")
        blocks = cut(light, max(parts, light.count() // RANGE)).join(bits.select("node", "n", "bits"), "node")
        got = written(candidates(blocks, limit, parts), f"{folder}/candidates{k}")
        granules = got.where("gid is not null")
        near = written(granule_pairs(granules, limit, parts, k == 0), f"{folder}/granules{k}")
        far = written(across(near.where("a <> b"), granules, limit), f"{folder}/across{k}")
        found = got.where("gid is null").select("cell", "a", "b").union(far)
        pairs = found.where("a <> b").select("a", "b").distinct()
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = written(pairs, f"{folder}/pairs{k}")
        partners = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        new_sets = bits.join(partners, "node", "left_semi").select("node", "doc_id", "name", "other")
        if full is not None:
            new_sets = new_sets.join(full.select("node"), "node", "left_anti")
        fetched = written(elements(docs, new_sets), f"{folder}/sets{k}")
        full = fetched if full is None else full.union(fetched)
        new = written(verify(pairs, full), f"{folder}/links{k}")
        links = new if links is None else links.union(new)
        compared = pairs if compared is None else compared.union(pairs)
        comp = components(links, f"{folder}/comp{k}")
        took = written(found.union(near).where("a = b").select("cell").distinct(), f"{folder}/took{k}")
        if took.isEmpty():
            break
        limit, k = limit * 4, k + 1

    # What is read from here on is the nodes and the last components.
    for name in ("cells", "bits", *(f"{x}{i}" for i in range(k + 1) for x in ("light", "done", "candidates", "granules", "across", "pairs", "sets", "links", "took")), *(f"comp{i}" for i in range(k))):
        drop_dir(spark, f"{folder}/{name}")
    ids = rows.select("doc_id", "n", "node").join(comp, "node", "left").select("doc_id", "n", F.when(F.col("node") != 0, F.coalesce("comp", "node")).alias("comp"))
    smallest = ids.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return ids.join(smallest, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def filtered(ids: DataFrame, many: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the rows whose h is one of ids (and some others), by a Bloom filter of at most 64 MB."""
    size = 1 << min(29, max(16, int(16 * many).bit_length()))

    def places(ids: pa.Array) -> list[np.ndarray]:
        h = ids.to_numpy().view(np.uint64)
        return [(mix(h + U(k)) & U(size - 1)).astype(np.int64) for k in (1, 2)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size >> 3, np.uint8)
        for b in batches:
            for at in places(b["h"]):
                np.bitwise_or.at(total, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield from emit_array(total)

    shared = ids.sparkSession.sparkContext.broadcast(summed_array(ids.mapInArrow(lean(mark), "part int, blob binary"), (size >> 3,), np.uint8, join=np.bitwise_or))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.logical_and(*((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 for at in places(b["h"])))
            yield b.filter(pa.array(own))

    return run


def elements(docs: DataFrame, of: DataFrame) -> DataFrame:
    """(node, elements): the sets of nodes, each from the text of one document; of: (node, doc_id, name, other).

    Texts are not shuffled: hashes of the ids, or of more than FEW a Bloom filter of bounded size, say which to take sets from,
    and the sets are joined. Where there are too many ids for the filter to tell them apart, only more sets are taken than needed.
    """
    spark = docs.sparkSession
    of = written(of, f"{shared_dir(spark)}/of")  # a row for each node with a partner
    if not (many := of.count()):
        return spark.createDataFrame([], "node long, elements binary")
    h = F.xxhash64("doc_id").alias("h")
    rows = docs.select("doc_id", "text", h)
    some = rows.join(F.broadcast(of.select(h)), "h", "left_semi") if many <= FEW else rows.mapInArrow(lean(filtered(of.select(h), many)), rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(*names_of(s), s.tobytes()) for s in sets(b["text"])]
            if got:
                yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary())))], names=["d", "v", "o", "elements"])

    found = some.select("doc_id", "text").mapInArrow(lean(run), f"d {docs.schema['doc_id'].dataType.simpleString()}, v long, o long, elements binary")
    met = (F.col("v") == F.col("name")) & (F.col("o") == F.col("other")) & F.col("d").eqNullSafe(F.col("doc_id"))
    return found.join(of, met).select("node", "elements").dropDuplicates(["node"])


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component one document, with the columns it came with: that with the smallest id, and of equal ids one.

    Rows are known by their id and a hash of all their columns, of any names and types (those that hold maps are hashed as
    JSON); a null id counts as greater than any other.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    hashed = [F.to_json(F.struct(col(f.name).alias("v"))) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else col(f.name) for f in docs.schema.fields]
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64(*hashed).alias("hash"))
    ids = written(join(docs.select(row.alias("doc_id"), "text"), folder), f"{folder}/ids")
    # Few documents go, so what goes is joined, not what stays.
    gone = written(ids.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone")).distinct(), f"{folder}/gone")
    again = written(ids.groupBy(F.col("doc_id").alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again"), f"{folder}/again")
    # A null within a row's name equals a null here: names are compared as text.
    name = lambda c: F.concat_ws("|", F.coalesce(c["id"].cast("string"), F.lit("null")), c["hash"].cast("string"))
    named = docs.select(F.struct(*(col(c) for c in docs.columns)).alias("row"), name(row).alias("name"))
    left = named.join(gone.select(name(F.col("gone")).alias("name")), "name", "left_anti")
    if not again.isEmpty():
        twice = again.select(name(F.col("again")).alias("name"))
        left = left.join(twice, "name", "left_anti").unionByName(left.join(twice, "name", "left_semi").dropDuplicates(["name"]))
    return left.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def verify(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                o = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * o >= PERCENT * (len(p) + len(q) - o))
            if any(keep):
                m = pa.array(keep)
                yield pa.RecordBatch.from_arrays([b["a"].filter(m), b["b"].filter(m)], names=["a", "b"])

    p = few(pairs).join(full.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a").join(full.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
    return p.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")
