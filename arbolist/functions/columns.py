"""Column functions over S-expressions.

A parsed column is a struct (SEXP_TYPE): the canonical key, which is equal exactly where the values are; the display text
where it is another; and the nodes in preorder, each with its elements' numbers and its place in key and text. Nothing of
the text is stored twice. Everything but parsing is built-in expressions over that struct. Null in, null out. A literal
second argument is parsed once, on the driver.

Functions that give an element or the rest of a list give a Part: a Column that knows of which value it is a part, so that a chain of
them is a chain of array accesses, whatever its depth, and a subtree is cut out only where it is itself a result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.classic.column import Column as ClassicColumn

from . import batch as B
from . import sexp as S

NODE_TYPE = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("c", T.ArrayType(T.IntegerType())), T.StructField("last", T.IntegerType()), T.StructField("t", T.StringType()),
    T.StructField("ks", T.IntegerType()), T.StructField("kl", T.IntegerType()), T.StructField("ts", T.IntegerType()), T.StructField("tl", T.IntegerType()),
])
SEXP_TYPE = T.StructType([T.StructField("key", T.StringType()), T.StructField("txt", T.StringType()), T.StructField("nodes", T.ArrayType(NODE_TYPE))])
SEXP, NODES = SEXP_TYPE.simpleString(), T.ArrayType(NODE_TYPE).simpleString()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Part(ClassicColumn):
    """A node of the parsed column `base`, or that list without its first `skip` elements.

    at: from a base to the node's number (null: its root). computed: whether base comes from Python, as parse_sexp() does; then
    it is bound to a name first, since functions within built-in expressions cannot hold it.
    """

    def __init__(self, base: Column, at: Callable[[Column], Column] | None = None, skip: int = 0, computed: bool = False):
        self.base, self.at, self.skip, self.computed = base, at, skip, computed
        self._made = None

    @property
    def _jc(self):
        if self._made is None:
            self._made = self.cut()._jc
        return self._made

    def within(self, body: Callable[[Part], Column]) -> Column:
        """body of this part of a base that may be repeated and be put anywhere."""
        return let(self.base, lambda b: body(Part(b, self.at, self.skip))) if self.computed else body(self)

    def whole(self, body: Callable[[Column], Column]) -> Column:
        """body of the part as a parsed value of its own."""
        return let(self.cut(), body) if self.computed or not self.is_base() else body(self.base)

    def is_base(self) -> bool:
        return self.at is None and not self.skip

    def number(self) -> Column:
        return F.lit(0) if self.at is None else self.at(self.base)

    def node(self, body: Callable[[Column], Column]) -> Column:
        """body of the node struct, which is null where there is no such node."""
        node = F.get(self.base["nodes"], self.number())
        return body(node) if self.at is None else let(node, body)

    def field(self, name: str) -> Column:
        return F.get(self.base["nodes"], self.number())[name]

    def element(self, k: Column | int) -> Part:
        """Element k; an atom is its own element 0."""
        place = F.lit(k + self.skip if k >= 0 else -1) if isinstance(k, int) else F.when(k >= 0, k + self.skip)
        return Part(self.base, lambda b: F.get(Part(b, self.at).field("c"), place), 0, self.computed)

    def listed(self, what: str, strict: bool) -> Part:
        """Itself; for an atom an error, or null if not strict."""
        if self.skip:
            return self
        atom = F.raise_error(F.lit(f"{what} requires a list")).cast("int") if strict else F.lit(None).cast("int")

        def checked(b: Column) -> Column:
            check = lambda i: F.when(F.get(b["nodes"], i)["t"].isin("symbol", "string", "integer", "float"), atom).otherwise(i)
            return check(F.lit(0)) if self.at is None else let(self.at(b), check)

        return Part(self.base, checked, 0, self.computed)

    def rest(self) -> Part:
        return Part(self.base, self.at, self.skip + 1, self.computed)

    def length(self) -> Column:
        """Elements of a list, 0 of nil, 1 of an atom."""
        size = F.array_size(self.field("c"))
        return size if not self.skip else let(size - self.skip, lambda n: F.when(n >= 0, n))

    def type(self) -> Column:
        return self.field("t") if not self.skip else let(self.length(), lambda n: F.when(n > 0, "list").when(n == 0, "nil"))

    def key(self) -> Column:
        if self.is_base():
            return self.base["key"]
        return self.within(lambda p: p.node(lambda n: p.written(n, "key", "ks", "kl")))

    def text(self) -> Column:
        if self.is_base():
            return F.coalesce(self.base["txt"], self.base["key"])
        return self.within(lambda p: p.node(lambda n: F.coalesce(p.written(n, "txt", "ts", "tl"), p.written(n, "key", "ks", "kl"))))

    def written(self, n: Column, what: str, start: str, size: str) -> Column:
        """Key or text of node n, which is a part of the root's."""
        if not self.skip:
            return F.substring(self.base[what], n[start] + 1, n[size])
        begin = F.get(self.base["nodes"], F.get(n["c"], F.lit(self.skip)))[start]
        some = F.concat(F.lit("("), F.substring(self.base[what], begin + 1, n[start] + n[size] - begin))
        nil = F.lit("()") if what == "key" else F.lit(None).cast("string")
        return F.when(F.array_size(n["c"]) > self.skip, some).when(F.array_size(n["c"]) == self.skip, nil)

    def cut(self) -> Column:
        """The part as a parsed value of its own."""
        if self.is_base():
            return self.base
        return self.within(lambda p: let(p.number(), lambda i: F.when(Part(p.base, lambda b: i, p.skip).type().isNotNull(), Part(p.base, lambda b: i, p.skip)._moved())))

    def _moved(self) -> Column:
        base, skip, me = self.base, self.skip, self.number()
        n = F.get(base["nodes"], me)
        floats = base["txt"].isNotNull()
        text = F.when(floats, self.written(n, "txt", "ts", "tl"))
        if not skip:
            # The text is null where it is the key, as in a value without floats.
            text = F.when(text != self.written(n, "key", "ks", "kl"), text)
            first, k0, t0 = me, n["ks"], n["ts"]
            nodes = let(F.struct(first.alias("i"), k0.alias("k"), F.when(text.isNotNull(), t0).alias("t")), lambda o: F.transform(F.slice(base["nodes"], me + 1, n["last"] - me + 1), lambda x: _shifted(x, o["i"], o["k"], o["t"])))
            return F.struct(self.written(n, "key", "ks", "kl").alias("key"), text.alias("txt"), nodes.alias("nodes")).cast(SEXP)
        at = F.get(n["c"], F.lit(skip))
        start = F.get(base["nodes"], at)
        key = self.written(n, "key", "ks", "kl")
        text = F.when(text != key, text)

        def nodes(o: Column) -> Column:
            root = F.struct(F.lit(0).alias("id"), F.transform(F.slice(n["c"], skip + 1, F.array_size(n["c"]) - skip), lambda j: j - o["i"]).alias("c"), (n["last"] - o["i"]).alias("last"), F.lit("list").alias("t"), F.lit(0).alias("ks"), F.length(key).alias("kl"), F.when(o["t"].isNotNull(), 0).alias("ts"), F.length(text).alias("tl"))
            return F.concat(F.array(root.cast(NODE_TYPE)), F.transform(F.slice(base["nodes"], at + 1, n["last"] - at + 1), lambda x: _shifted(x, o["i"], o["k"], o["t"])))

        own = let(F.struct((at - 1).alias("i"), (start["ks"] - 1).alias("k"), F.when(text.isNotNull(), start["ts"] - 1).alias("t")), nodes)
        return F.when(at.isNull(), literal("()").cut()).otherwise(F.struct(key.alias("key"), text.alias("txt"), own.alias("nodes")).cast(SEXP))


def _shifted(x: Column, i: Column, k: Column, t: Column) -> Column:
    """A node of a larger value as one of a part that begins at node i, at character k of the key and t of the text."""
    return F.struct((x["id"] - i).alias("id"), F.transform(x["c"], lambda j: j - i).alias("c"), (x["last"] - i).alias("last"), x["t"].alias("t"), (x["ks"] - k).alias("ks"), x["kl"].alias("kl"), (x["ts"] - t).alias("ts"), F.when(t.isNotNull(), x["tl"]).alias("tl")).cast(NODE_TYPE)


def part(x: Column | str) -> Part:
    return x if isinstance(x, Part) else Part(F.col(x) if isinstance(x, str) else x)


def _arrow(f: Callable[..., pa.Array], kind: T.DataType | str) -> Callable[..., Column]:
    made = F.arrow_udf(f, kind)
    return lambda *cols: made(*cols)


def _parsed(texts: pa.Array) -> pa.Array:
    return B.parse_column(texts)


def _try_parsed(texts: pa.Array) -> pa.Array:
    return B.parse_column(texts, strict=False)


_parse, _try_parse = _arrow(_parsed, SEXP_TYPE), _arrow(_try_parsed, SEXP_TYPE)


def parse_sexp(text: Column | str) -> Column:
    """Text to a parsed value; text that is no S-expression is an error."""
    return Part(_parse(text), computed=True)


def try_parse_sexp(text: Column | str) -> Column:
    """Text to a parsed value; null where text is no S-expression."""
    return Part(_try_parse(text), computed=True)


def recv(data: Column | str) -> Column:
    """A parsed value from the binary form that send() gives."""
    return parse_sexp(F.decode(data, "UTF-8"))


def send(x: Column | str) -> Column:
    return F.encode(sexp_text(x), "UTF-8")


def sexp_nil() -> Column:
    """The constant nil, parsed."""
    return literal("()")


def literal(text: str) -> Part:
    """A parsed constant."""

    def lit(v: object, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.struct(*(lit(v[f.name], f.dataType).alias(f.name) for f in kind.fields))
        if isinstance(kind, T.ArrayType):
            return F.array(*(lit(x, kind.elementType) for x in v)).cast(kind)
        return F.lit(v).cast(kind)

    return Part(lit(S.value(S.parse(text)), SEXP_TYPE))


def sexp_text(x: Column | str) -> Column:
    """Display text. Floats are printed with 17 digits, so text is no key: 2.0 prints as 2."""
    return part(x).text()


def sexp_key(x: Column | str) -> Column:
    """The canonical key: to compare, join, group and count distinct values by."""
    return part(x).key()


def sexp_typeof(x: Column | str) -> Column:
    return part(x).type()


def is_nil(x: Column | str) -> Column:
    return sexp_typeof(x) == "nil"


def is_list(x: Column | str) -> Column:
    return sexp_typeof(x).isin("list", "nil")


def is_atom(x: Column | str) -> Column:
    return ~is_list(x)


def is_symbol(x: Column | str) -> Column:
    return sexp_typeof(x) == "symbol"


def is_string(x: Column | str) -> Column:
    return sexp_typeof(x) == "string"


def is_number(x: Column | str) -> Column:
    return sexp_typeof(x).isin("integer", "float")


def sexp_length(x: Column | str) -> Column:
    """Elements of a list, 0 of nil, 1 of an atom."""
    return part(x).length()


def nth(x: Column | str, k: Column | int) -> Part:
    """Element k, from 0; null outside the list; an atom is its own element 0."""
    return part(x).element(k)


def car(x: Column | str, strict: bool = True) -> Part:
    """The first element; null of nil; of an atom an error, or null if not strict."""
    return part(x).listed("car", strict).element(0)


head = car


def cdr(x: Column | str, strict: bool = True) -> Part:
    """The list without its first element; nil after the only one; null of nil; of an atom an error, or null if not strict."""
    return part(x).listed("cdr", strict).rest()


def at_path(x: Column | str, path: Sequence[int]) -> Part:
    """What nth() along a path gives."""
    out = part(x)
    for k in path:
        out = out.element(k)
    return out


sexp_path = at_path


def sexp_int(x: Column | str, path: Sequence[int] = ()) -> Column:
    """The integer at a path; null if the value there is none."""
    return at_path(x, path).within(lambda p: p.node(lambda n: F.when(n["t"] == "integer", p.written(n, "key", "ks", "kl").cast("long"))))


def sexp_float(x: Column | str, path: Sequence[int] = ()) -> Column:
    """The number at a path, as a double; null if the value there is none."""

    def number(p: Part, n: Column) -> Column:
        return F.when(n["t"] == "integer", p.written(n, "key", "ks", "kl").cast("double")).when(n["t"] == "float", p.written(n, "txt", "ts", "tl").cast("double"))

    return at_path(x, path).within(lambda p: p.node(lambda n: number(p, n)))


def sexp_str(x: Column | str, path: Sequence[int] = ()) -> Column:
    """The characters of the string or the name of the symbol at a path; null if the value there is neither."""

    def plain(quoted: Column) -> Column:
        """Backslashes stand in pairs or before one other character, so what lies between pairs is read by itself."""
        body = F.substring(quoted, F.lit(2), F.length(quoted) - 2)

        def unescaped(s: Column) -> Column:
            for a, b in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"')):
                s = F.replace(s, F.lit(a), F.lit(b))
            return s

        return F.when(F.contains(quoted, F.lit("\\")), F.array_join(F.transform(F.split(body, r"\\\\", -1), unescaped), "\\")).otherwise(body)

    def characters(p: Part, n: Column) -> Column:
        key = p.written(n, "key", "ks", "kl")
        return F.when(n["t"] == "string", let(key, plain)).when(n["t"] == "symbol", key)

    return at_path(x, path).within(lambda p: p.node(lambda n: characters(p, n)))


def _element(x: Column, k: Column) -> Column:
    return F.get(x["nodes"], k)


def _text_of(x: Column, n: Column) -> Column:
    return F.coalesce(F.substring(x["txt"], n["ts"] + 1, n["tl"]), F.substring(x["key"], n["ks"] + 1, n["kl"]))


def sexp_to_map(x: Column | str) -> Column:
    """MAP of name to text from the `(symbol value)` elements of a list; the last of equal names counts."""

    def build(x: Column) -> Column:
        lists = F.filter(F.transform(F.get(x["nodes"], F.lit(0))["c"], lambda j: _element(x, j)), lambda n: (n["t"] == "list") & (F.size(n["c"]) == 2))
        pairs = F.transform(lists, lambda n: F.struct(_element(x, F.get(n["c"], F.lit(0))).alias("a"), _element(x, F.get(n["c"], F.lit(1))).alias("b")))
        entries = F.transform(F.filter(pairs, lambda p: p["a"]["t"] == "symbol"), lambda p: F.struct(_text_of(x, p["a"]).alias("key"), _text_of(x, p["b"]).alias("value")))
        # Of equal names the last: found by its place among the names backwards.
        return let(F.reverse(entries), lambda e: F.map_from_entries(F.reverse(F.filter(e, lambda v, i: F.array_position(e["key"], v["key"]) == i + 1))))

    return part(x).whole(build)


def sexp_eq(a: Column | str, b: Column | str) -> Column:
    return sexp_key(a) == sexp_key(b)


def sexp_ne(a: Column | str, b: Column | str) -> Column:
    return sexp_key(a) != sexp_key(b)


def key_hash(key: Column) -> Column:
    """32-bit hash of a canonical key; 0 of nil's."""
    return F.when(key == "()", 0).when(key.isNotNull(), F.hash(key))


def key_hash_extended(key: Column, seed: Column) -> Column:
    return F.when(seed == 0, key_hash(key).cast("long")).when(key.isNotNull(), F.xxhash64(key, seed))


def sexp_hash(x: Column | str) -> Column:
    """32-bit hash, equal for equal values; 0 of nil."""
    return let(sexp_key(x), key_hash)


def sexp_hash_extended(x: Column | str, seed: Column | int) -> Column:
    """64-bit hash by seed; seed 0 gives sexp_hash()."""
    seed = F.lit(seed).cast("long") if isinstance(seed, int) else seed
    return let(sexp_key(x), lambda k: key_hash_extended(k, seed))


def _by_keys(f: Callable[[S.Node, S.Node], object], kind: pa.DataType, spark_kind: T.DataType | str) -> Callable[[Column, Column], Column]:
    """A function of two parsed columns, evaluated in Arrow batches from their keys; equal pairs of a batch are evaluated once."""

    def run(c: pa.Array, q: pa.Array) -> pa.Array:
        done: dict[tuple, object] = {}
        known: dict[str, S.Node] = {}
        out = []
        for pair in zip(c.to_pylist(), q.to_pylist(), strict=True):
            if None in pair:
                out.append(None)
                continue
            if pair not in done:
                if pair[1] not in known:
                    known[pair[1]] = S.from_key(pair[1])
                done[pair] = f(S.from_key(pair[0]), known[pair[1]])
            out.append(done[pair])
        return pa.array(out, kind)

    made = _arrow(run, spark_kind)
    return lambda c, q: made(sexp_key(c), sexp_key(q))


def _found(c: S.Node, p: S.Node) -> dict | None:
    return S.value(S.find(c, p))


def _captures(c: S.Node, p: S.Node) -> list[tuple[str, str]] | None:
    out: dict[str, str] = {}
    return list(out.items()) if S.matches(c, p, out) else None


_contains_key_udf = _by_keys(S.contains_key, pa.bool_(), T.BooleanType())
_match_udf = _by_keys(S.matches, pa.bool_(), T.BooleanType())
_find_udf = _by_keys(_found, B.VALUE, SEXP_TYPE)
_captures_udf = _by_keys(_captures, pa.map_(pa.string(), pa.string()), T.MapType(T.StringType(), T.StringType()))


def sexp_contains(x: Column | str, needle: str | Column) -> Column:
    """Whether a subtree of x, x included, equals needle (text, or a parsed column).

    A subtree's key is a part of the root's, which is looked at first, and by the Parquet scan; then nodes are, by their length.
    """
    from ..plans.compile import is_key

    def test(x: Column, key: Column, size: Column) -> Column:
        return F.contains(x["key"], key) & F.exists(x["nodes"], lambda n: is_key(x, n, key, size))

    if isinstance(needle, str):
        key = S.parse(needle).key
        return part(x).whole(lambda x: test(x, F.lit(key), F.lit(len(key))))
    return let(F.struct(part(x).cut().alias("x"), sexp_key(needle).alias("k")), lambda s: test(s["x"], s["k"], F.length(s["k"])))


def sexp_contained(needle: str | Column, x: Column | str) -> Column:
    return sexp_contains(x, needle)


def sexp_contains_key(x: Column | str, needle: str | Column) -> Column:
    """Whether a list anywhere in x has the needle's head and, in any order, its further elements, lists by the same rule."""
    from ..plans.compile import contains_key, contains_key_column

    if isinstance(needle, str):
        return part(x).whole(lambda x: contains_key(x, S.parse(needle)))
    return contains_key_column(part(x), part(needle))


def sexp_contained_key(needle: str | Column, x: Column | str) -> Column:
    return sexp_contains_key(x, needle)


def sexp_match(x: Column | str, pattern: str | Column) -> Column:
    """Whether x as a whole fits a pattern: `_` and `?name` any value, `_*` and `??name` the rest of a list."""
    from ..plans.compile import match

    return part(x).whole(lambda x: match(x, S.parse(pattern))) if isinstance(pattern, str) else _match_udf(x, pattern)


def sexp_find(x: Column | str, pattern: str | Column) -> Column:
    """The first subtree, parents first, that fits a pattern; null if none does."""
    from ..plans.compile import found

    if not isinstance(pattern, str):
        return _find_udf(x, pattern)
    own = part(x)
    base, computed = (own.base, own.computed) if own.is_base() else (own.cut(), True)
    return Part(base, lambda b: F.get(found(b, S.parse(pattern)), F.lit(0))["id"], 0, computed)


def sexp_find_all(x: Column | str, pattern: str) -> Column:
    """Display texts of all subtrees that fit a pattern, parents first."""
    from ..plans.compile import found

    return part(x).whole(lambda x: F.transform(found(x, S.parse(pattern)), lambda n: _text_of(x, n)))


def sexp_captures(x: Column | str, pattern: str) -> Column:
    """MAP of the names in a pattern to the texts that they stand for; null where x does not fit."""
    from ..plans.compile import captures

    return part(x).whole(lambda x: captures(x, S.parse(pattern)))


def sexp_keys(x: Column | str) -> Column:
    """Keys of an inverted index: atoms (a), heads of lists (h), two-element lists of a symbol and an atom (p)."""

    def keys(x: Column) -> Column:
        key = lambda n: F.substring(x["key"], n["ks"] + 1, n["kl"])
        atoms = F.transform(F.filter(x["nodes"], lambda n: n["t"] != "list"), lambda n: F.concat(F.lit("a"), key(n)))
        lists = F.filter(x["nodes"], lambda n: n["t"] == "list")
        heads = F.transform(lists, lambda n: F.concat(F.lit("h"), key(_element(x, n["id"] + 1))))
        pairs = F.transform(F.filter(lists, lambda n: (F.size(n["c"]) == 2) & (_element(x, n["id"] + 1)["t"] == "symbol") & (n["last"] == n["id"] + 2)), lambda n: F.concat(F.lit("p"), key(n)))
        return F.array_distinct(F.concat(atoms, heads, pairs))

    return part(x).whole(keys)


def query_keys(needle: str, by_key: bool) -> list[str]:
    """Keys that any value that holds needle has; by_key: for sexp_contains_key(), where pairs say nothing."""
    return S.index_keys(S.parse(needle), pairs=not by_key)
