"""Literal needles and patterns as Columns over a parsed column.

Every list of a needle becomes an exists() over the elements of the node that it may match, so that a query is one filter of
built-in expressions, and an element of a pattern is an array access. Whatever a value must hold is first looked for in its key,
as plain conditions that Parquet gets as pushed filters.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import sexp as S

#: Levels of lists that a needle column is compared by in built-in expressions. Deeper needles are evaluated from keys.
DEEP = 3


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions) if conditions else F.lit(True)


def is_key(x: Column, n: Column, key: Column, size: Column) -> Column:
    """Whether node n of x has the key, of the given length."""
    return (n["kl"] == size) & (F.substring(x["key"], n["ks"] + 1, n["kl"]) == key)


def equals(x: Column, n: Column, q: S.Node) -> Column:
    return is_key(x, n, F.lit(q.key), F.lit(len(q.key)))


def element(x: Column, n: Column, k: int) -> Column:
    return F.get(x["nodes"], F.get(n["c"], F.lit(k)))


def further(n: Column) -> Column:
    """Numbers of a list's elements from the second on."""
    return F.slice(n["c"], 2, F.greatest(F.size(n["c"]) - 1, F.lit(0)))


def contains_key(x: Column, q: S.Node) -> Column:
    if q.t != "list":
        return F.contains(x["key"], F.lit(q.key)) & F.exists(x["nodes"], lambda n: equals(x, n, q))
    return prefilter_key(x["key"], q) & F.exists(x["nodes"], lambda n: _has_elements(x, n, q))


def prefilter_key(key: Column, q: S.Node) -> Column:
    """A condition on a root's key that follows from what the value must hold: every atom of q but wildcards."""
    return all_of([F.contains(key, F.lit(k)) for k in dict.fromkeys(a.key for a in S.walk(q) if a.t != "list" and not S.wild(a))])


def _has_elements(x: Column, n: Column, q: S.Node) -> Column:
    """Whether the list at node n has q's head and, at places from 1, each further element of q."""
    own = [n["t"] == "list", F.size(n["c"]) >= len(q.kids), equals(x, element(x, n, 0), q.kids[0])]
    for want in q.kids[1:]:
        own.append(F.exists(further(n), _fits_one(x, want)))
    return all_of(own)


def _fits_one(x: Column, want: S.Node):
    test = _has_elements if want.t == "list" else equals
    return lambda j: test(x, F.get(x["nodes"], j), want)


def contains_key_column(x: C.Part, q: C.Part) -> Column:
    """The same for a needle column: in built-in expressions as far as its lists nest no deeper than DEEP.

    Deeper needles go to Arrow batches, which get null for all others; so does everything that comes from Python anyway.
    """
    if x.computed or q.computed:
        return C._contains_key_udf(x, q)
    own = C.let(F.struct(x.cut().alias("x"), q.cut().alias("q")), lambda s: _shallow(s["x"], s["q"]))
    deep = q.whole(lambda w: _deeper(w, F.get(w["nodes"], F.lit(0)), DEEP))
    by_batch = C._contains_key_udf(F.struct(F.when(deep, x.key()).alias("key")), F.struct(F.when(deep, q.key()).alias("key")))
    return F.coalesce(by_batch, own)


def _shallow(x: Column, q: Column) -> Column:
    like = F.exists(x["nodes"], lambda n: _like(x, n, q, F.get(q["nodes"], F.lit(0)), DEEP))
    return F.when(x["key"].isNotNull() & q["key"].isNotNull(), F.coalesce(like, F.lit(False)))


def _deeper(q: Column, n: Column, levels: int) -> Column:
    """Whether lists nest deeper than some levels below node n (elements from the second on; heads are compared by key)."""
    if not levels:
        return n["t"] == "list"
    return (n["t"] == "list") & F.exists(further(n), lambda j: _deeper(q, F.get(q["nodes"], j), levels - 1))


def _like(x: Column, n: Column, q: Column, m: Column, levels: int, top: bool = True) -> Column:
    """Whether node n of x is like node m of q: equal if m is no list; else by the rule of contains_key()."""
    key = lambda v, k: F.substring(v["key"], k["ks"] + 1, k["kl"])
    same = (n["kl"] == m["kl"]) & (key(x, n) == key(q, m))
    if not levels:
        return same & (m["t"] != "list")
    heads = (element(x, n, 0)["kl"] == element(q, m, 0)["kl"]) & (key(x, element(x, n, 0)) == key(q, element(q, m, 0)))
    every = F.forall(further(m), lambda i: F.exists(further(n), lambda j: _like(x, F.get(x["nodes"], j), q, F.get(q["nodes"], i), levels - 1)))
    return F.when(m["t"] == "list", (n["t"] == "list") & (F.size(n["c"]) >= F.size(m["c"])) & heads & every).otherwise(same)


def match(x: Column, p: S.Node) -> Column:
    """Whether the root fits the pattern."""
    return prefilter_key(x["key"], p) & F.when(x["key"].isNotNull(), F.coalesce(fits(x, F.get(x["nodes"], F.lit(0)), p), F.lit(False)))


def found(x: Column, p: S.Node) -> Column:
    """The nodes that fit the pattern, parents first."""
    return F.filter(x["nodes"], lambda n: F.coalesce(fits(x, n, p), F.lit(False)))


def fixed_of(p: S.Node) -> tuple[list[S.Node], bool]:
    """(elements of a list pattern that stand for one value each, whether a rest follows)."""
    rest = S.wild(p.kids[-1]) == "*"
    return (p.kids[:-1] if rest else p.kids), rest


def fits(x: Column, n: Column, p: S.Node) -> Column:
    """Whether the subtree at node n fits the pattern."""
    w = S.wild(p)
    if w:
        return F.lit(w == "_")
    if p.t != "list" or not any(S.wild(y) for y in S.walk(p)):
        return equals(x, n, p)
    fixed, rest = fixed_of(p)
    if any(S.wild(y) == "*" for y in fixed):
        return F.lit(False)
    own = [n["t"] == "list", F.size(n["c"]) >= len(fixed) if rest else F.size(n["c"]) == len(fixed)]
    return all_of(own + [fits(x, element(x, n, k), want) for k, want in enumerate(fixed) if S.wild(want) != "_"])


def captures(x: Column, p: S.Node) -> Column:
    """MAP of the pattern's names to the texts that they stand for; null where the root does not fit. The last of equal names counts."""
    names: dict[str, Column] = {}

    def collect(own: C.Part, q: S.Node) -> None:
        if S.wild(q) == "_":
            if q.v != "_":
                names[q.v[1:]] = own.text()
        elif q.t == "list":
            fixed, rest = fixed_of(q)
            for k, y in enumerate(fixed):
                collect(own.element(k), y)
            if rest and q.kids[-1].v != "_*":
                names[q.kids[-1].v[2:]] = C.Part(own.base, own.at, len(fixed)).text()

    collect(C.Part(x), p)
    pairs = [c for name, text in names.items() for c in (F.lit(name), text)]
    out = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.when(match(x, p), out)


def prefilter(key: Column, needle: str, by_key: bool = False) -> Column:
    """A condition on a root's key that follows from sexp_contains (or, by_key, sexp_contains_key) of the needle."""
    q = S.parse(needle)
    return prefilter_key(key, q) if by_key else F.contains(key, F.lit(q.key))
