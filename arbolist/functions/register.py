"""Names for spark.sql(): every function of the value type, over STRING columns that hold expression text.

The functions parse and evaluate whole Arrow batches; DataFrame code should parse once and use arbolist.functions.columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import batch as B
from . import columns as C
from . import sexp as S


def _text(node: S.Node | None) -> str | None:
    return None if node is None else node.txt


def _captures(c: S.Node, p: S.Node) -> dict[str, str] | None:
    out: dict[str, str] = {}
    return out if S.matches(c, p, out) else None


class Values:
    """A batch of texts as parsed values (functions.batch), which are read without a node object for each row."""

    def __init__(self, texts: pa.Array):
        v = B.parse_column(texts)
        self.key, self.txt = v.field("key").to_pylist(), v.field("txt").to_pylist()
        self.nodes = v.field("nodes")
        flat, off = self.nodes.flatten(), self.nodes.offsets.to_numpy()
        self.first = off - off[0]
        self.type, self.ks, self.kl, self.ts, self.tl = (flat.field(c).to_pylist() for c in ("t", "ks", "kl", "ts", "tl"))
        kids = flat.field("c")
        self.kids, self.kids_off = kids.flatten().to_numpy(), kids.offsets.to_numpy() - kids.offsets.to_numpy()[0]

    def text(self, i: int, node: int | None = None, rest: int = 0) -> str | None:
        """Display text of row i, of a node of it, or of that list without its first elements."""
        if node is None and not rest:
            return self.key[i] if self.txt[i] is None else self.txt[i]
        at = self.first[i] + (node or 0)
        own, start, size = (self.key[i], self.ks, self.kl) if self.txt[i] is None else (self.txt[i], self.ts, self.tl)
        if not rest:
            return own[start[at] : start[at] + size[at]]
        if self.length(i) <= rest:
            return "()" if self.length(i) == rest else None
        return "(" + own[start[self.first[i] + self.element(i, rest)] : start[at] + size[at]]

    def root(self, i: int) -> str:
        return self.type[self.first[i]]

    def length(self, i: int) -> int:
        return int(self.kids_off[self.first[i] + 1] - self.kids_off[self.first[i]])

    def element(self, i: int, k: int) -> int | None:
        return int(self.kids[self.kids_off[self.first[i]] + k]) if 0 <= k < self.length(i) else None

    def nth(self, i: int, k: int) -> str | None:
        at = self.element(i, k)
        return None if at is None else self.text(i, at)

    def listed(self, i: int, what: str, strict: bool) -> bool:
        if self.root(i) in ("list", "nil"):
            return True
        if strict:
            raise S.SexpError(f"{what} requires a list")
        return False

    def car(self, i: int, strict: bool = True) -> str | None:
        return self.nth(i, 0) if self.listed(i, "car", strict) else None

    def cdr(self, i: int, strict: bool = True) -> str | None:
        return self.text(i, None, 1) if self.listed(i, "cdr", strict) else None


#: name: (function of a batch and a row's number, result type).
ONE: dict[str, tuple[Callable[[Values, int], object], str]] = {
    "sexp_in": (Values.text, "string"), "sexp_out": (Values.text, "string"), "sexp_key": (lambda v, i: v.key[i], "string"), "sexp_typeof": (Values.root, "string"),
    "sexp_send": (lambda v, i: v.text(i).encode(), "binary"), "sexp_length": (Values.length, "int"),
    "car": (Values.car, "string"), "head": (Values.car, "string"), "cdr": (Values.cdr, "string"), "try_car": (lambda v, i: v.car(i, False), "string"), "try_cdr": (lambda v, i: v.cdr(i, False), "string"),
    "is_nil": (lambda v, i: v.root(i) == "nil", "boolean"), "is_list": (lambda v, i: v.root(i) in ("list", "nil"), "boolean"), "is_atom": (lambda v, i: v.root(i) not in ("list", "nil"), "boolean"),
    "is_symbol": (lambda v, i: v.root(i) == "symbol", "boolean"), "is_string": (lambda v, i: v.root(i) == "string", "boolean"), "is_number": (lambda v, i: v.root(i) in ("integer", "float"), "boolean"),
    "sexp_extract_keys": (lambda v, i: S.index_keys(S.from_key(v.key[i])), "array<string>"), "sexp_extract_query_keys": (lambda v, i: S.index_keys(S.from_key(v.key[i]), pairs=False), "array<string>"),
}
#: name: (function of two values, result type, what it gives where the first lacks an atom that it would have to hold).
TWO: dict[str, tuple[Callable[[S.Node, S.Node], object], str, object]] = {
    "sexp_contains": (S.contains, "boolean", False), "sexp_contains_key": (S.contains_key, "boolean", False), "sexp_match": (S.matches, "boolean", False),
    "sexp_find": (lambda c, p: _text(S.find(c, p)), "string", None), "sexp_find_all": (lambda c, p: [x.txt for x in S.find_all(c, p)], "array<string>", []), "sexp_captures": (_captures, "map<string,string>", None),
}
#: Functions whose second argument is a pattern: its wildcards need not be held.
PATTERNS = ("sexp_match", "sexp_find", "sexp_find_all", "sexp_captures")
#: Functions that are SQL over the others: name, body after the argument list.
SQL = {
    "sexp_nil": "() RETURNS STRING RETURN '()'",
    "sexp_eq": "(a STRING, b STRING) RETURNS BOOLEAN RETURN sexp_key(a) = sexp_key(b)",
    "sexp_ne": "(a STRING, b STRING) RETURNS BOOLEAN RETURN sexp_key(a) <> sexp_key(b)",
    "sexp_contained": "(needle STRING, x STRING) RETURNS BOOLEAN RETURN sexp_contains(x, needle)",
    "sexp_contained_key": "(needle STRING, x STRING) RETURNS BOOLEAN RETURN sexp_contains_key(x, needle)",
    "sexp_key_hash": "(k STRING) RETURNS INT RETURN CASE WHEN k IS NULL THEN NULL WHEN k = '()' THEN 0 ELSE hash(k) END",
    "sexp_hash": "(x STRING) RETURNS INT RETURN sexp_key_hash(sexp_key(x))",
    "sexp_key_hash_extended": "(k STRING, seed BIGINT) RETURNS BIGINT RETURN CASE WHEN k IS NULL THEN NULL WHEN seed = 0 THEN cast(sexp_key_hash(k) AS BIGINT) ELSE xxhash64(k, seed) END",
    "sexp_hash_extended": "(x STRING, seed BIGINT) RETURNS BIGINT RETURN sexp_key_hash_extended(sexp_key(x), seed)",
}


class Nodes:
    """Rows of all nodes of an expression, parents first."""

    def eval(self, text: str):
        if text is not None:
            kids = [(S.parse(text), None, 0)]
            at = 0
            while kids:
                node, parent, place = kids.pop()
                yield at, parent, place, node.t, node.txt
                kids += [(k, at, i) for i, k in reversed(list(enumerate(node.kids)))]
                at += 1


def _known(texts: pa.Array) -> list[int]:
    return np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False)).tolist()


def _result(values: dict[int, object], n: int, kind: T.DataType) -> pa.Array:
    return pa.array([list(v.items()) if isinstance(v := values.get(i), dict) else v for i in range(n)], to_arrow_type(kind))


def _of_one(f: Callable[[Values, int], object], kind: T.DataType) -> Callable[[pa.Array], pa.Array]:
    def run(texts: pa.Array) -> pa.Array:
        v = Values(texts)
        return _result({i: f(v, i) for i in _known(texts)}, len(texts), kind)

    return run


def _of_two(f: Callable[[S.Node, S.Node], object], kind: T.DataType, else_: object, pattern: bool) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """f where the first value's key holds every atom of the second; equal second texts are parsed once."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        keys, texts, parsed, out = B.parse_column(x).field("key").to_pylist(), y.to_pylist(), {}, {}
        for i in _known(x):
            if texts[i] is None:
                continue
            if texts[i] not in parsed:
                q = S.parse(texts[i])
                parsed[texts[i]] = q, {a.key for a in S.walk(q) if a.t != "list" and not (pattern and S.wild(a))}
            q, atoms = parsed[texts[i]]
            out[i] = f(S.from_key(keys[i]), q) if all(a in keys[i] for a in atoms) else else_
        return _result(out, len(x), kind)

    return run


def _nth(texts: pa.Array, k: pa.Array) -> pa.Array:
    v, at = Values(texts), k.to_pylist()
    return _result({i: v.nth(i, at[i]) for i in _known(texts) if at[i] is not None}, len(texts), T.StringType())


def _recv(data: pa.Array) -> pa.Array:
    return _of_one(Values.text, T.StringType())(data.cast(pa.string()))


def register(spark: SparkSession) -> list[str]:
    """Register every function; returns the names."""
    kinds = {
        "string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "binary": T.BinaryType(), "array<string>": T.ArrayType(T.StringType()),
        "map<string,string>": T.MapType(T.StringType(), T.StringType()),
    }
    for name, (f, kind) in ONE.items():
        spark.udf.register(name, F.arrow_udf(_of_one(f, kinds[kind]), kinds[kind]))
    for name, (f, kind, else_) in TWO.items():
        spark.udf.register(name, F.arrow_udf(_of_two(f, kinds[kind], else_, name in PATTERNS), kinds[kind]))
    spark.udf.register("nth", F.arrow_udf(_nth, T.StringType()))
    spark.udf.register("sexp_recv", F.arrow_udf(_recv, T.StringType()))
    spark.udf.register("parse_sexp", F.arrow_udf(C._parsed, C.SEXP_TYPE))
    spark.udf.register("try_parse_sexp", F.arrow_udf(C._try_parsed, C.SEXP_TYPE))
    for name, body in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udtf.register("sexp_nodes", F.udtf(Nodes, returnType="id int, parent int, place int, kind string, txt string"))
    return [*ONE, *TWO, "nth", "sexp_recv", "parse_sexp", "try_parse_sexp", *SQL, "sexp_nodes"]
