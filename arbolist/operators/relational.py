"""Relational operators on S-expression columns: all work on canonical keys, so Spark's own joins and aggregates do them.

Values are given as Columns; a part of a larger value (nth(), cdr(), ...) is read in place, not cut out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def group_by_sexp(df: DataFrame, value: Column, *aggregates: Column, name: str = "value") -> DataFrame:
    """Aggregates for each distinct value; the group is shown by its display text."""
    key = C.sexp_key(value)
    return df.groupBy(key.alias("\0key")).agg(F.first(C.sexp_text(value)).alias(name), *aggregates).drop("\0key")


def equi_join(left: DataFrame, right: DataFrame, left_value: Column, right_value: Column, how: str = "inner") -> DataFrame:
    """Join on equality of values; Catalyst picks hash or sort-merge on the keys."""
    a, b = left.withColumn("\0left", C.sexp_key(left_value)), right.withColumn("\0right", C.sexp_key(right_value))
    return a.join(b, a["\0left"] == b["\0right"], how).drop("\0left", "\0right")


def theta_join(values: DataFrame, needles: DataFrame, value: str, needle: str, by: str = "contains") -> DataFrame:
    """Rows of values beside the needles that they contain (by: contains, contains_key) or fit (match); both parsed columns.

    No nested loop: a needle is met through one thing that a value must hold. For contains that is the needle itself, among the
    value's subtrees, which decides; for the others it is the needle's longest atom (for patterns, of those that are no
    wildcards), and the predicate is evaluated for the pairs that share it. A pattern of wildcards alone meets every value.
    Only keys are dealt out, and of a value's only those that some needle asks for; values come back by 128 bits of hash of their own key.
    """
    named = values.select(F.struct(*(F.col(_quoted(c)) for c in values.columns)).alias("v"))
    named = named.withColumn("row", F.struct(F.xxhash64(F.col("v").getField(value)["key"]).alias("a"), F.xxhash64(F.col("v").getField(value)["key"], F.lit(1)).alias("b")))
    asked = needles.select(F.struct(*(F.col(_quoted(c)) for c in needles.columns)).alias("q"))
    q, v = F.col("q").getField(needle), F.col("v").getField(value)
    own = lambda x, n: F.substring(x["key"], n["ks"] + 1, n["kl"])
    if by == "contains":
        wanted, parts = q["key"], v["nodes"]
    else:
        atoms = F.filter(q["nodes"], lambda n: (n["t"] != "list") & (F.lit(by != "match") | ~own(q, n).rlike(r"^(\?|_$|_\*$)")))
        longest = F.array_max(F.transform(atoms, lambda n: F.struct(n["kl"].alias("n"), own(q, n).alias("k"))))
        wanted, parts = F.coalesce(longest["k"], F.lit("")), F.filter(v["nodes"], lambda n: n["t"] != "list")
    keys = F.array_distinct(F.concat(F.array(F.lit("")) if by == "match" else F.array().cast("array<string>"), F.transform(parts, lambda n: own(v, n))))
    asked = asked.withColumn("k", wanted)
    met = named.select("row", F.explode(keys).alias("k")).join(asked.select("k").distinct(), "k", "left_semi").distinct()
    pairs = met.join(asked, "k").drop("k").join(named, "row")
    if by == "contains_key":
        pairs = pairs.where(C.sexp_contains_key(v, q))
    elif by == "match":
        pairs = pairs.where(C.sexp_match(v, q))
    return pairs.select("v.*", "q.*")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def distinct_values(df: DataFrame, value: Column) -> DataFrame:
    """One row for each distinct value: its key and its display text."""
    return df.select(C.sexp_key(value).alias("key"), C.sexp_text(value).alias("txt")).groupBy("key").agg(F.first("txt").alias("txt"))
