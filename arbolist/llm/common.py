"""What the training-data operators share: written intermediate tables, folds, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch. Documents can be long, so batches hold few.
BATCH_ROWS, BATCH_BYTES = 256, "16m"


def tables(sf_dir: str, spark: SparkSession, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Python workers' memory low: documents can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quoted(name: str) -> str:
    """A column's name as Spark parses it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; deleted when the session's JVM ends.

    Where the setting is absent on a local master (tests), a temporary folder becomes it; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="arbolist-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/arbolist-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet and read it again: cuts lineage, and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts. A null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts


#: What operators keep in a Python worker from task to task; lean() empties these.
KEPT_IN_WORKER: list[dict] = []
#: Bytes that a worker may grow by before it is looked at what it can give back.
GROWN = 32 << 20
_least = 0


def give_back() -> None:
    """Return freed memory to the system where this process has grown: workers stay for later stages, whose tasks need room beside them."""
    global _least
    with contextlib.suppress(OSError, AttributeError):  # elsewhere than on Linux with glibc
        if resident() > _least + GROWN:
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)
            _least = resident()


def forget_others() -> None:
    for kept in KEPT_IN_WORKER:
        kept.clear()


def resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, for mapInArrow, with nothing of other operators beside it, and what it freed given back.

    The function that is sent names those of this module, and holds nothing of what the driver keeps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        yield from f(batches)
        give_back()

    return run


def by_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow, from a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := f(b)) is not None and out.num_rows:
                yield out
        give_back()

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, bound: int, most: int = 32 << 20) -> DataFrame:
    """(id, y) of at most `bound` labelled training documents of together at most `most` bytes, chosen by a hash of the id.

    Labels that are null are left out; if an id has several, it is 1 when at least half are. Both bounds are parameters of the
    caller and limit nothing but the rows that a classifier is fitted on; both labels get half of each. A text that alone
    is beyond its share is left out. The result is a local table of at most `bound` rows, which may be broadcast.
    """
    spark = docs.sparkSession
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out).groupBy(F.col("doc_id").alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    place, keep = F.pmod(F.xxhash64("id"), F.lit(1_000_000)), F.lit(False)
    for y, n in counts.items():
        keep = keep | ((F.col("y") == y) & (place < int(min(1.0, bound / 2 / n) * 1_000_000)))
    ids = spark.createDataFrame(rows.where(keep).orderBy(place, "id").limit(2 * bound).collect(), rows.schema)  # about `bound` rows
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0))
    sizes = docs.select("doc_id", size.alias("size")).join(F.broadcast(ids), F.col("doc_id") == F.col("id")).groupBy("id").agg(F.first("y").alias("y"), F.min("size").alias("size"))
    left = {y: [bound // 2, most // 2] for y in counts}
    out = []
    for r in sorted(sizes.select("id", "y", "size", place.alias("place")).collect(), key=lambda r: (r["place"], str(r["id"]))):
        room = left[r["y"]]
        if room[0] >= 1 and r["size"] <= room[1]:
            room[0], room[1] = room[0] - 1, room[1] - r["size"]
            out.append((r["id"], r["y"]))
    return spark.createDataFrame(out, rows.schema)


def sampled_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """y and text of the documents that labelled_sample() chose: of rows that repeat an id, one with the shortest text (equal ones: the first in order)."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("id"))
    return rows.groupBy("id").agg(F.first("y").alias("y"), F.min(F.struct(F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), F.col("text").alias("text")))["text"].alias("text")).select("y", "text")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights and, last, the intercept of a small dense logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, weight = np.zeros(x.shape[1]), np.ones(len(x)) if weight is None else weight
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) / len(x) + l2 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x / len(x) + l2 * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def emit_array(total: np.ndarray, cells: int = 1 << 13) -> Iterator[pa.RecordBatch]:
    """An accumulated array as rows (part, blob) of `cells` numbers each; parts that are all zero are left out."""
    flat = total.ravel()
    parts = [i for i in range(0, len(flat), cells) if flat[i : i + cells].any()]
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([i // cells for i in parts], pa.int32()), pa.array([flat[i : i + cells].tobytes() for i in parts], pa.binary())], names=["part", "blob"])


def summed_array(rows: DataFrame, shape: tuple[int, ...], dtype: type, cells: int = 1 << 13, join: np.ufunc = np.add) -> np.ndarray:
    """The sum (or another join) over tasks of what emit_array() gave: an array of fixed size, whatever the input.

    Summed in two steps, first in as many groups as there are shuffle partitions, so that no task reads a part of every task.
    The sums come to the driver in one job: they are of the array's size, and a job for each partition would be as many in turn.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for part, blob in zip(b["part"].to_pylist(), b["blob"].to_pylist(), strict=True):
                a = np.frombuffer(blob, dtype)
                held[part] = join(held[part], a) if part in held else a.copy()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([a.tobytes() for a in held.values()], pa.binary())], names=["part", "blob"])

    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = "part int, blob binary"
    first = rows.repartition(n, F.expr("pmod(xxhash64(spark_partition_id(), part), 1024)")).mapInArrow(lean(add), kind)
    total = np.zeros(int(np.prod(shape)), dtype)
    for r in first.repartition(n, "part").mapInArrow(lean(add), kind).collect():  # of fixed size
        a = np.frombuffer(r["blob"], dtype)
        at = slice(r["part"] * cells, r["part"] * cells + len(a))
        total[at] = join(total[at], a)
    return total.reshape(shape)
