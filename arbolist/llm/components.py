"""Connected components of an undirected graph whose edges are a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, written


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the graph with edges a, b, for each node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    p = np.arange(len(nodes))
    while True:
        low = np.minimum(p[x], p[y])
        q = p.copy()
        for k in (x, y, p[x], p[y]):
            np.minimum.at(q, k, low)
        q = q[q]
        if (q == p).all():
            return nodes, nodes[p]
        p = q


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning star for each component of the edges that a task reads, some hundred thousand edges at a time."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        node, root = roots(a, b)
        other = node != root
        return pa.RecordBatch.from_arrays([pa.array(root[other]), pa.array(node[other])], names=["a", "b"])

    for batch in batches:
        held.append((batch["a"].to_numpy(), batch["b"].to_numpy()))
        size += batch.num_rows
        if size > 500_000:
            yield out()
            held, size = [], 0
    if size:
        yield out()


#: Edges that one task may hold. A graph that is as small, or has become so by contraction, is finished in one step.
SMALL = 200_000


def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, comp) for all nodes of the few edges that the one task reads."""
    held = [(b["a"].to_numpy(), b["b"].to_numpy()) for b in batches]
    if held:
        node, root = roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "to"])


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, comp) for every node of edges (a long, b long): comp is a node of its component.

    Every round contracts each node into its smallest neighbour; the graph at least halves, so rounds grow with the logarithm
    of the nodes, and no task holds a component of unbounded size: only a graph of at most SMALL edges goes to one task. Each
    round's tables are written, so lineage stays short.
    """
    spark = edges.sparkSession
    kind = "a long, b long"
    e = edges.select("a", "b").where("a <> b").mapInArrow(lean(forest), kind)
    e = written(e.distinct(), f"{folder}/e0")  # dealt out by both ends: a star's edges go to all tasks
    maps: list[DataFrame] = []
    while (left := e.count()) > 0:
        k = len(maps)
        if left <= SMALL:
            maps.append(written(e.coalesce(1).mapInArrow(lean(named), "node long, to long"), f"{folder}/m{k}"))
            break
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")), f"{folder}/m{k}")
        maps.append(to)
        x = e.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        x = x.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").mapInArrow(lean(forest), kind)
        e = written(x.distinct(), f"{folder}/e{k + 1}")
    if not maps:
        return spark.createDataFrame([], "node long, comp long")
    # Nodes of round k are contracted into nodes of round k + 1 or into nodes that no later round has.
    out = maps[-1].select("node", F.col("to").alias("comp"))
    for to in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("to"), "comp")
        out = to.join(later, "to", "left").select("node", F.coalesce("comp", "to").alias("comp"))
    return written(out, f"{folder}/out")
