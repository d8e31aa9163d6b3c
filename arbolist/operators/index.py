"""Indexes over S-expressions, as tables that a lookup reads a small part of.

Inverted index: postings (key, id), one row for each distinct key of a value, and counts (key, n), both in directories by the
key's hash and sorted by key, so a lookup reads only its keys' row groups. The counts say which of the needle's keys are rare:
only their postings are read, and none where all are so common that a scan with the predicate's own prefilter costs less.
Candidates become ranges of ids, which skip row groups where values are clustered by id, and the predicate itself is
evaluated: an index never decides alone.

Hash index: (key, id) of whole values or of a part of each, in directories by the key's hash, with a Bloom filter in each file.
bucketed() stores a table so that joins on keys need no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import sexp as S

PARTS = 64
#: Candidates that are put to the scan, and the ranges that they make.
LISTED, RANGES = 10_000, 16


@dataclass
class Index:
    """postings: part, key, id; counts: part, key, n."""

    postings: DataFrame
    counts: DataFrame


def part_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def postings(values: DataFrame, id_col: str = "id", sexp_col: str = "sx") -> DataFrame:
    """(part, key, id): a row for each index key of each value."""
    rows = values.select(F.col(id_col).alias("id"), F.explode(C.sexp_keys(sexp_col)).alias("key"))
    return rows.select(part_of(F.col("key")).alias("part"), "key", "id")


def _write(own: DataFrame, path: str) -> DataFrame:
    """Written below path, a directory for each part, sorted by key for row-group statistics; read again."""
    order = [c for c in ("part", "key", "id") if c in own.columns]
    sorted_rows = own.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows.write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").partitionBy("part").parquet(path)
    return own.sparkSession.read.schema(own.schema).parquet(path)


def write_index(values: DataFrame, path: str, id_col: str = "id", sexp_col: str = "sx") -> Index:
    """The inverted index of a parsed column."""
    own = _write(postings(values, id_col, sexp_col), f"{path}/postings")
    return Index(own, _write(own.groupBy("part", "key").agg(F.count("*").alias("n")), f"{path}/counts"))


def write_hash_index(values: DataFrame, path: str, value: Column, id_col: str = "id") -> DataFrame:
    """The hash index of a value: a parsed column, or a part of one."""
    rows = values.select(F.col(id_col).alias("id"), C.sexp_key(value).alias("key"))
    return _write(rows.select(part_of(F.col("key")).alias("part"), "key", "id"), path)


def ids_equal(index: DataFrame, text: str) -> DataFrame:
    """Ids of the values that equal an expression, by a hash index."""
    key = F.lit(S.parse(text).key)
    return index.where((F.col("part") == part_of(key)) & (F.col("key") == key)).select("id")


def bucketed(values: DataFrame, table: str, buckets: int, value: Column, name: str = "sx_key") -> DataFrame:
    """A stored table with the value's key as a column, in buckets by it: joins and aggregates on that key need no shuffle."""
    keyed = values.withColumn(name, C.sexp_key(value))
    keyed.write.mode("overwrite").format("parquet").bucketBy(buckets, name).sortBy(name).saveAsTable(table)
    return values.sparkSession.table(table)


def of_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.where(F.col("part").isin([part_of(F.lit(k)) for k in keys]) & F.col("key").isin(keys))


def ids_for(index: Index, needle: str, by_key: bool = False, most: int = LISTED) -> DataFrame | None:
    """Ids of values that have the needle's rarest keys: candidates, not answers. None where these are more than `most`."""
    keys = C.query_keys(needle, by_key)
    counts = {r["key"]: r["n"] for r in of_keys(index.counts, keys).collect()}  # a row for each key of the needle
    least = min((counts.get(k, 0) for k in keys), default=0)
    if least > most:
        return None
    rare = [k for k in keys if counts.get(k, 0) <= 2 * least]
    hits = of_keys(index.postings, rare)
    if len(rare) == 1:
        return hits.select("id")
    return hits.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select("id")


def in_ranges(id_col: str, ids: list) -> Column:
    """A condition that the ids alone fulfil, with ranges around them that a scan can skip by: cut at the widest gaps."""
    ids = sorted(ids)
    gaps = sorted(range(1, len(ids)), key=lambda k: ids[k] - ids[k - 1], reverse=True) if not isinstance(ids[0], str) else []
    cuts = [0, *sorted(gaps[: RANGES - 1]), len(ids)]
    near = F.lit(False)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        near = near | ((F.col(id_col) == ids[a]) if a + 1 == b else F.col(id_col).between(ids[a], ids[b - 1]))
    return near & F.col(id_col).isin(ids)


def lookup(values: DataFrame, index: Index, needle: str, by_key: bool = False, id_col: str = "id", sexp_col: str = "sx") -> DataFrame:
    """The rows of values that contain the needle (by_key: by sexp_contains_key), by way of the index."""
    test = C.sexp_contains_key(sexp_col, needle) if by_key else C.sexp_contains(sexp_col, needle)
    ids = ids_for(index, needle, by_key)
    if ids is None:
        return values.where(test)
    few = [r["id"] for r in ids.collect()]  # at most LISTED
    return values.where(in_ranges(id_col, few) & test) if few else values.where(F.lit(False))
