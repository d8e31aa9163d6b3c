"""The registered queries of the expression engine, one or more for each operator, and the SQL that gives the same rows.

Each query runs over a whole table whose rows are expressions (see sources.tables); the SQL says the same in terms of the
source columns, so it shares nothing with the engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.register import register
from ..operators import index as I
from ..operators import relational as R
from ..sources import tables as S
from ..streaming import windows as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Literals of the value grammar with what they are (fixed values).
SAMPLES = (("hello", "symbol"), ("42", "integer"), ("-7", "integer"), ("+5", "integer"), ("3.14", "float"), (".5", "float"), ("5.", "float"), ("1e10", "symbol"), ("\"text\"", "string"), ("()", "nil"), ("nil", "nil"), ("NIL", "symbol"), ("(a b)", "list"), ("(a . b)", "list"), ("; only a comment", "nil"), ("+", "symbol"), ("1.2.3", "symbol"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def ev(spark: SparkSession, d: str) -> DataFrame:
    return S.ingested(spark, d, "events")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return S.ingested(spark, d, "orders")


def samples(spark: SparkSession) -> DataFrame:
    return S.parsed(spark.createDataFrame([(a,) for a, _ in SAMPLES], "lit string"), F.col("lit"))


def scratch_name() -> str:
    return f"arbolist_{uuid.uuid4().hex}"


def values(rows: list[tuple], names: str) -> str:
    put = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(put, r)) + ')' for r in rows)}) t({names})"


K = "cast(json_extract_string(props, '$.k') AS VARCHAR)"
CENTS = "cast(floor(value * 100) AS BIGINT)"
EV_TEXT = f"printf('(event %d (type \"%s\") (user %d) (value %d) (props (k %s)))', event_id, event_type, user_id, {CENTS}, {K})"


# Parsing and printing (T1-T7)
@query(f"SELECT event_id, {EV_TEXT} AS txt FROM events")
def parse_roundtrip(spark, d):
    return ev(spark, d).select("event_id", C.sexp_text("sx").alias("txt"))


@query(f"SELECT event_id, {EV_TEXT} AS txt FROM events")
def send_recv(spark, d):
    sent = ev(spark, d).select("event_id", C.send("sx").alias("b"))
    return sent.select("event_id", C.sexp_text(C.recv("b")).alias("txt"))


@query("SELECT count(*) AS n, sum(length(text)) AS chars FROM documents")
def doc_strings_with_quotes(spark, d):
    return S.ingested(spark, d, "documents").select(C.sexp_str("sx", (4, 1)).alias("s")).agg(F.count("*").alias("n"), F.sum(F.length("s")).cast("decimal(38,0)").alias("chars"))


@query("SELECT doc_id, text AS txt FROM documents")
def doc_string_values(spark, d):
    return S.ingested(spark, d, "documents").select("doc_id", C.sexp_str("sx", (4, 1)).alias("txt"))


@query("SELECT count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS bad FROM events")
def try_parse_errors(spark, d):
    text = F.when(F.col("event_type") == "click", F.concat(F.lit("(broken "), "event_type")).otherwise(F.concat(F.lit("("), "event_type", F.lit(")")))
    out = S.read(spark, d, "events").select(C.try_parse_sexp(text).alias("sx"))
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("sx").isNull()).cast("decimal(38,0)").alias("bad"))


@query(values([("3.14", "3.1400000000000001"), ("2.0", "2"), ("100000000000000000000.", "1e+20"), ("99999999999999999999", "9223372036854775807"), ("(a  ;c\n b)", "(a b)"), ("\"x\\ny\"", "\"x\\ny\"")], "lit, txt"))
def print_literals(spark, d):
    lits = ["3.14", "2.0", "100000000000000000000.", "99999999999999999999", "(a  ;c\n b)", "\"x\\ny\""]
    return S.parsed(spark.createDataFrame([(x,) for x in lits], "lit string"), F.col("lit")).select("lit", C.sexp_text("sx").alias("txt"))


@query("SELECT count(*) AS n FROM events")
def nil_constant(spark, d):
    return S.read(spark, d, "events").select(C.sexp_nil().alias("x")).where(C.is_nil("x")).agg(F.count("*").alias("n"))


@query("SELECT n, n < 1000 AS parsed, CASE WHEN n < 1000 THEN 2 * n + 1 END AS chars FROM (VALUES (1), (998), (999), (1000), (1200)) t(n)")
def depth_limit(spark, d):
    """Lists within lists, around a symbol of one letter."""
    rows = spark.createDataFrame([(1,), (998,), (999,), (1000,), (1200,)], "n int")
    text = F.concat(F.repeat(F.lit("("), F.col("n")), F.lit("a"), F.repeat(F.lit(")"), F.col("n")))
    out = rows.select("n", C.sexp_text(C.try_parse_sexp(text)).alias("txt"))
    return out.select("n", F.col("txt").isNotNull().alias("parsed"), F.length("txt").alias("chars"))


@query("SELECT printf('(nation (name \"%s\") (region (name \"%s\")))', n_name, r_name) AS txt FROM nation JOIN region ON n_regionkey = r_regionkey")
def text_connector(spark, d):
    """Written as text, a value a line, and read again."""
    path = f"{S.scratch(spark)}/lines"
    S.write_text(S.ingested(spark, d, "nation"), path)
    return S.read_text(spark, path).select(C.sexp_text("sx").alias("txt"))


# Inspection (P1-P7)
@query(values(list(SAMPLES), "lit, t"))
def typeof_literals(spark, d):
    return samples(spark).select("lit", C.sexp_typeof("sx").alias("t"))


@query(values([(a, t == "nil", t in ("nil", "list"), t not in ("nil", "list"), t == "symbol", t == "string", t in ("integer", "float")) for a, t in SAMPLES], "lit, p_nil, p_list, p_atom, p_symbol, p_string, p_number"))
def type_predicates(spark, d):
    checks = {"p_nil": C.is_nil, "p_list": C.is_list, "p_atom": C.is_atom, "p_symbol": C.is_symbol, "p_string": C.is_string, "p_number": C.is_number}
    return samples(spark).select("lit", *(f("sx").alias(n) for n, f in checks.items()))


@query("SELECT 'list' AS t, 6 * count(*) AS n FROM events UNION ALL SELECT 'symbol', 6 * count(*) FROM events UNION ALL SELECT 'string', count(*) FROM events UNION ALL SELECT 'integer', 4 * count(*) FROM events")
def typeof_counts(spark, d):
    return ev(spark, d).select(F.explode("sx.nodes.t").alias("t")).groupBy("t").agg(F.count("*").alias("n"))


# Navigation (A1-A7)
@query("SELECT 'event' AS head, count(*) AS n FROM events")
def car_group(spark, d):
    return R.group_by_sexp(ev(spark, d), C.car("sx"), F.count("*").alias("n"), name="head")


@query("SELECT 'order' AS head, count(*) AS n FROM orders")
def head_group(spark, d):
    return R.group_by_sexp(orders(spark, d), C.head("sx"), F.count("*").alias("n"), name="head")


@query(f"SELECT event_id, printf('(%d (type \"%s\") (user %d) (value %d) (props (k %s)))', event_id, event_type, user_id, {CENTS}, {K}) AS txt FROM events")
def cdr_text(spark, d):
    return ev(spark, d).select("event_id", C.sexp_text(C.cdr("sx")).alias("txt"))


@query("SELECT o_orderkey, printf('(cust %d)', o_custkey) AS txt, 2 AS len FROM orders")
def cdr_cdr_car(spark, d):
    third = C.car(C.cdr(C.cdr("sx")))
    return orders(spark, d).select("o_orderkey", C.sexp_text(third).alias("txt"), C.sexp_length(third).alias("len"))


@query("SELECT event_id, printf('(type \"%s\")', event_type) AS txt, cast(NULL AS VARCHAR) AS beyond FROM events")
def nth_access(spark, d):
    return ev(spark, d).select("event_id", C.sexp_text(C.nth("sx", 2)).alias("txt"), C.sexp_text(C.nth("sx", 99)).alias("beyond"))


@query("SELECT user_id AS u, count(*) AS n FROM events GROUP BY user_id")
def path_access(spark, d):
    return ev(spark, d).groupBy(C.sexp_int("sx", (3, 1)).alias("u")).agg(F.count("*").alias("n"))


@query(f"SELECT {K} AS k, count(*) AS n FROM events GROUP BY 1")
def chained_nth(spark, d):
    inner = C.nth(C.nth(C.nth("sx", 5), 1), 1)
    return R.group_by_sexp(ev(spark, d), inner, F.count("*").alias("n"), name="k")


@query("SELECT avg(6.0) AS len FROM events")
def length_avg(spark, d):
    return ev(spark, d).agg(F.avg(C.sexp_length("sx")).alias("len"))


@query(values([("hello", 1), ("42", 1), ("()", 0), ("(a b)", 2), ("\"text\"", 1)], "lit, len"))
def length_literals(spark, d):
    return samples(spark).where(F.col("lit").isin("hello", "42", "()", "(a b)", '"text"')).select("lit", C.sexp_length("sx").alias("len"))


@query(values([("hello", None, None), ("()", None, None), ("(a b)", "a", "(b)")], "lit, first, rest"))
def try_car_cdr(spark, d):
    rows = samples(spark).where(F.col("lit").isin("hello", "()", "(a b)"))
    return rows.select("lit", C.sexp_text(C.car("sx", strict=False)).alias("first"), C.sexp_text(C.cdr("sx", strict=False)).alias("rest"))


# Equality and hashing (E1-E6)
@query("SELECT count(*) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus AND a.o_orderpriority = b.o_orderpriority WHERE a.o_orderkey < b.o_orderkey")
def eq_join(spark, d):
    rows = orders(spark, d).select("o_orderkey", "sx")
    other = rows.select(F.col("o_orderkey").alias("other"), F.col("sx").alias("so"))
    return R.equi_join(rows, other, C.cdr(C.cdr("sx")), C.cdr(C.cdr("so"))).where("o_orderkey < other").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT (event_type, user_id)) AS n FROM events")
def eq_distinct(spark, d):
    pair = ev(spark, d).select(F.concat(C.sexp_key(C.nth("sx", 2)), C.sexp_key(C.nth("sx", 3))).alias("k"))
    return pair.agg(F.count_distinct("k").alias("n"))


@query("SELECT DISTINCT printf('(user %d)', user_id) AS txt FROM events")
def eq_distinct_values(spark, d):
    return R.distinct_values(ev(spark, d), C.nth("sx", 3)).select("txt")


@query("SELECT count(*) AS n FROM events WHERE event_type <> 'click'")
def ne_filter(spark, d):
    return ev(spark, d).where(C.sexp_ne(C.nth("sx", 2), C.literal('(type "click")'))).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) AS same, 0 AS nil_hash FROM events")
def hash_consistency(spark, d):
    """An element taken from a larger value hashes like the same value parsed by itself."""
    taken, alone = C.nth("sx", 2), C.parse_sexp(F.format_string('( type   "%s" )', "event_type"))
    rows = ev(spark, d).select(C.sexp_hash(taken).alias("a"), C.sexp_hash(alone).alias("b"), C.sexp_hash_extended(taken, 0).alias("c"), C.sexp_hash_extended(taken, 7).alias("e"), C.sexp_hash_extended(alone, 7).alias("f"), C.sexp_hash(C.sexp_nil()).alias("z"))
    return rows.agg(F.count("*").alias("n"), F.count_if((F.col("a") == F.col("b")) & (F.col("a") == F.col("c")) & (F.col("e") == F.col("f"))).alias("same"), F.max("z").alias("nil_hash"))


@query(values([("42", "42.0", False), ("-0.0", "0.0", True), ("(a b)", "( a b ) ; c", True), ("\"a\"", "a", False), ("nil", "()", True), ("+5", "5", True)], "a, b, eq"))
def eq_literals(spark, d):
    rows = spark.createDataFrame([("42", "42.0"), ("-0.0", "0.0"), ("(a b)", "( a b ) ; c"), ('"a"', "a"), ("nil", "()"), ("+5", "5")], "a string, b string")
    return rows.select("a", "b", C.sexp_eq(C.parse_sexp("a"), C.parse_sexp("b")).alias("eq"))


# Containment (C1-C5)
@query("SELECT count(*) AS n FROM events WHERE event_type = 'click'")
def contains_string(spark, d):
    return ev(spark, d).where(C.sexp_contains("sx", '"click"')).agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE event_type = 'purchase'")
def contains_pair(spark, d):
    return ev(spark, d).where(C.sexp_contains("sx", '(type "purchase")')).select("event_id")


@query(f"SELECT count(*) AS n FROM events WHERE 42 IN (event_id, user_id, {CENTS}, cast({K} AS BIGINT))")
def contains_atom(spark, d):
    """Only where the number is an element, not where its digits are."""
    return ev(spark, d).where(C.sexp_contains("sx", "42")).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n FROM events WHERE {K} = '7'")
def contains_sublist(spark, d):
    return ev(spark, d).where(C.sexp_contains("sx", "(props (k 7))")).agg(F.count("*").alias("n"))


@query("SELECT 0 AS n")
def contains_is_exact(spark, d):
    """A list that has further elements is no equal list."""
    return ev(spark, d).where(C.sexp_contains("sx", "(event (type))")).agg(F.count("*").cast("int").alias("n"))


@query("SELECT event_type AS t, count(*) AS n FROM events GROUP BY 1")
def contains_column(spark, d):
    rows = ev(spark, d).withColumn("needle", C.nth("sx", 2))
    return rows.where(C.sexp_contains("sx", F.col("needle"))).groupBy(F.col("event_type").alias("t")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM events WHERE user_id = 7")
def contained_by(spark, d):
    return ev(spark, d).where(C.sexp_contained("(user 7)", "sx")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM events WHERE event_type = 'click'")
def contains_key_pair(spark, d):
    return ev(spark, d).where(C.sexp_contains_key("sx", '(event (type "click"))')).agg(F.count("*").alias("n"))


@query(f"SELECT event_id FROM events WHERE event_type = 'view' AND {K} = '3'")
def contains_key_nested(spark, d):
    return ev(spark, d).where(C.sexp_contains_key("sx", '(event (props (k 3)) (type "view"))')).select("event_id")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def contains_key_multi(spark, d):
    return orders(spark, d).where(C.sexp_contains_key("sx", '(order (priority "1-URGENT") (status "O"))')).agg(F.count("*").alias("n"))


#: (value, needle, whether it holds it by key), and (value, pattern, whether it fits): fixed values.
HELD = (("(sum 5 6 7)", "(sum 7 5)", True), ("(sum 5 6)", "(sum 5 6 7)", False), ('(pet (kind "cat") (age 9))', "(pet (age 9))", True), ('(pet (kind "cat") (age 9))', '(pet (kind "dog"))', False), ('(pet (kind "cat") (age 9))', '(kind "cat")', True), ("(p q)", "(p)", True), ("(w ())", "()", True), ("(p q)", "(p q q)", False), ("(p (q (r (s (t 1)))))", "(p (q (r (s (t 1)))))", True), ("(p (q (r (s (t 1 2)))))", "(p (q (r (s (t 2)))))", True), ("(p (q (r (s (t 1 2)))))", "(p (q (r (s (t 3)))))", False))
FITTING = (("(let y 10)", "(let _ _)", True), ("(let y 10)", "(let z _)", False), ("(sum 5)", "(sum _*)", True), ("(sum)", "(sum ??r)", True), ("()", "(_*)", False), ("(p q r)", "(_* r)", False), ("(g (h 4 5) 6)", "(g (_ _*) _)", True), ("kite", "_", True), ("kite", "_*", False))


@query(values(list(HELD), "c, q, hit"))
def contains_key_literals(spark, d):
    rows = spark.createDataFrame([r[:2] for r in HELD], "c string, q string")
    return rows.select("c", "q", C.sexp_contains_key(C.parse_sexp("c"), C.parse_sexp("q")).alias("hit"))


@query("SELECT count(*) AS n FROM events")
def contained_key(spark, d):
    """The needle is a column: each event's own user."""
    rows = ev(spark, d).select("sx", C.parse_sexp(F.format_string("(event (user %d))", "user_id")).alias("needle"))
    return rows.where(C.sexp_contained_key(F.col("needle"), "sx")).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n FROM events WHERE {K} = '3'")
def contains_key_column(spark, d):
    """Needles of two kinds, by row: each event's own user beside a fixed property."""
    needle = C.parse_sexp(F.format_string("(event (props (k 3)) (user %d))", "user_id"))
    rows = ev(spark, d).select("sx", needle.alias("needle"))
    return rows.where(C.sexp_contains_key("sx", F.col("needle"))).agg(F.count("*").alias("n"))


# Patterns (M1-M5)
@query("SELECT count(*) AS n FROM events WHERE event_type = 'click'")
def match_rest(spark, d):
    return ev(spark, d).where(C.sexp_match("sx", '(event _ (type "click") _*)')).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM events WHERE user_id = 11")
def match_nested(spark, d):
    return ev(spark, d).where(C.sexp_match("sx", "(event ?id (type _) (user 11) (value _) (props (_ _)))")).agg(F.count("*").alias("n"))


@query(values(list(FITTING), "c, p, hit"))
def match_literals(spark, d):
    rows = spark.createDataFrame([r[:2] for r in FITTING], "c string, p string")
    return rows.select("c", "p", C.sexp_match(C.parse_sexp("c"), C.parse_sexp("p")).alias("hit"))


@query("SELECT event_id, printf('(user %d)', user_id) AS txt, cast(NULL AS VARCHAR) AS none FROM events")
def find_first(spark, d):
    return ev(spark, d).select("event_id", C.sexp_text(C.sexp_find("sx", "(user _)")).alias("txt"), C.sexp_text(C.sexp_find("sx", "(x y)")).alias("none"))


@query(f"SELECT event_type AS t, sum({CENTS}) AS cents FROM events GROUP BY 1")
def find_typed_sum(spark, d):
    cents = C.sexp_int(C.sexp_find("sx", "(value _)"), (1,))
    return ev(spark, d).groupBy(C.sexp_str("sx", (2, 1)).alias("t")).agg(F.sum(cents).cast("decimal(38,0)").alias("cents"))


@query("SELECT l_linenumber AS line, count(*) AS n, 2 * count(*) AS products FROM lineitem GROUP BY 1")
def find_all_products(spark, d):
    found = C.sexp_find_all("sx", "(* _ _)")
    return S.ingested(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("line")).agg(F.count("*").alias("n"), F.sum(F.size(found)).alias("products"))


@query("SELECT event_id, event_id AS id, printf('((user %d) (value %d) (props (k %s)))', user_id, " + CENTS + f", {K}) AS tail FROM events")
def captures(spark, d):
    m = C.sexp_captures("sx", "(event ?id (type _) ??tail)")
    return ev(spark, d).select("event_id", F.element_at(m, "id").cast("long").alias("id"), F.element_at(m, "tail").alias("tail"))


@query("SELECT o_orderkey, printf('%d', o_custkey) AS cust, printf('\"%s\"', o_orderstatus) AS status FROM orders")
def record_map(spark, d):
    m = C.sexp_to_map("sx")
    return orders(spark, d).select("o_orderkey", F.element_at(m, "cust").alias("cust"), F.element_at(m, "status").alias("status"))


@query("SELECT sum(cast(l_quantity AS BIGINT) * (100 - cast(round(l_discount * 100) AS INT)) * (100 + cast(round(l_tax * 100) AS INT))) AS total FROM lineitem")
def typed_arithmetic(spark, d):
    at = lambda *p: C.sexp_int("sx", p)
    return S.ingested(spark, d, "lineitem").agg(F.sum(at(1, 1) * (at(1, 2, 1) - at(1, 2, 2)) * (at(2, 1) + at(2, 2))).cast("decimal(38,0)").alias("total"))


@query("SELECT event_id, cast(concat(event_id, '.', lpad(cast(event_id % 100 AS VARCHAR), 2, '0')) AS DOUBLE) AS amount, cast(event_id AS DOUBLE) AS whole FROM events")
def typed_floats(spark, d):
    text = F.format_string("(m %d.%02d %d)", "event_id", F.col("event_id") % 100, "event_id")
    rows = S.read(spark, d, "events").select("event_id", C.parse_sexp(text).alias("x"))
    return rows.select("event_id", C.sexp_float("x", (1,)).alias("amount"), C.sexp_float("x", (2,)).alias("whole"))


# Indexes (G1-G8, E5)
_indexes: dict[tuple, object] = {}


def indexed(spark: SparkSession, d: str, name: str, make: Callable[[str], object]):
    """An index of the events, made once for a session and for each state of the table."""
    key = (spark.sparkContext.applicationId, d, name, S.version(spark, f"{d}/events.parquet"))
    if key not in _indexes:
        _indexes[key] = make(f"{S.scratch(spark)}/{name}")
    return _indexes[key]


def event_index(spark: SparkSession, d: str) -> I.Index:
    return indexed(spark, d, "postings", lambda path: I.write_index(ev(spark, d), path, "event_id"))


def user_index(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d, "users", lambda path: I.write_hash_index(ev(spark, d), path, C.nth("sx", 3), "event_id"))


@query("SELECT event_id AS id FROM events WHERE user_id = 7")
def hash_index_scan(spark, d):
    """One directory of the index is read, of which statistics and Bloom filters leave what may hold the key."""
    return I.ids_equal(user_index(spark, d), "(user 7)")


@query("SELECT count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey")
def bucketed_join(spark, d):
    """Both sides are stored in buckets by the value's key, so neither is shuffled."""
    names = scratch_name(), scratch_name()
    left = S.read(spark, d, "customer").select("c_custkey", C.parse_sexp(F.format_string("(cust %d)", "c_custkey")).alias("v"))
    a = I.bucketed(left, names[0], 8, F.col("v"))
    b = I.bucketed(orders(spark, d).select("o_orderkey", "sx"), names[1], 8, C.nth("sx", 2))
    out = spark.createDataFrame([(a.hint("merge").join(b, "sx_key").count(),)], "n long")
    for name in names:
        spark.sql(f"DROP TABLE {name}")
    return out


@query(f"""SELECT 'heads' AS what, 6 * count(*) AS n FROM events UNION ALL SELECT 'pairs', 4 * count(*) FROM events
    UNION ALL SELECT 'atoms', sum(6 + 1 + len(list_distinct([event_id, user_id, {CENTS}, cast({K} AS BIGINT)]))) FROM events""")
def gin_keys(spark, d):
    """Index keys by kind: six heads (five symbols, `k`), pairs of a symbol and an atom, and distinct atoms."""
    what = F.expr("CASE substring(key, 1, 1) WHEN 'h' THEN 'heads' WHEN 'p' THEN 'pairs' ELSE 'atoms' END")
    return event_index(spark, d).postings.groupBy(what.alias("what")).agg(F.count("*").cast("decimal(38,0)").alias("n"))


@query("SELECT n_name, 10 AS of_value, 8 AS of_needle FROM nation")
def sql_index_keys(spark, d):
    """Five atoms, three heads and two pairs; a needle by key has no pairs."""
    register(spark)
    S.ingested(spark, d, "nation").select("n_name", C.sexp_text("sx").alias("txt")).createOrReplaceTempView("arbolist_nation_texts")
    return spark.sql("SELECT n_name, size(sexp_extract_keys(txt)) AS of_value, size(sexp_extract_query_keys(txt)) AS of_needle FROM arbolist_nation_texts")


@query("SELECT event_id FROM events WHERE event_type = 'click'")
def gin_lookup_contains(spark, d):
    return I.lookup(ev(spark, d), event_index(spark, d), '(type "click")', id_col="event_id").select("event_id")


@query("SELECT event_id FROM events WHERE user_id = 5 AND event_type = 'view'")
def gin_lookup_key(spark, d):
    return I.lookup(ev(spark, d), event_index(spark, d), '(event (user 5) (type "view"))', by_key=True, id_col="event_id").select("event_id")


@query("SELECT count(*) AS n FROM events WHERE event_id = 123")
def gin_lookup_selective(spark, d):
    return I.lookup(ev(spark, d), event_index(spark, d), "(event 123)", by_key=True, id_col="event_id").agg(F.count("*").alias("n"))


# Relational operators over expressions (section 2.8)
@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def theta_join_contains(spark, d):
    regions = S.read(spark, d, "region").withColumn("needle", C.parse_sexp(F.format_string('(region (name "%s"))', "r_name")))
    return R.theta_join(S.ingested(spark, d, "nation").select("n_name", "sx"), regions.select("r_name", "needle"), "sx", "needle").select("n_name", "r_name")


@query("SELECT n_name, r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name < 'B' OR n_name < 'C'")
def theta_join_contains_key(spark, d):
    """Needles name a region, some a nation too, in another order than values do."""
    pairs = S.read(spark, d, "nation").join(S.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = F.format_string('(nation (region (name "%s")))', "r_name")
    two = F.format_string('(nation (region (name "%s")) (name "%s"))', "r_name", "n_name")
    needles = pairs.where("r_name < 'B'").select("r_name", one.alias("t")).distinct().unionByName(pairs.where("n_name < 'C' AND NOT r_name < 'B'").select("r_name", two.alias("t"))).select("r_name", C.parse_sexp("t").alias("needle"))
    return R.theta_join(S.ingested(spark, d, "nation").select("n_name", "n_nationkey", "sx"), needles, "sx", "needle", "contains_key").select("n_name", "r_name", "n_nationkey")


@query("SELECT n_name, r_name AS p FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'any' FROM nation UNION ALL SELECT n_name, 'all' FROM nation")
def theta_join_match(spark, d):
    """Patterns of a region each, one with a head alone, and one of wildcards alone."""
    own = S.read(spark, d, "region").select(F.col("r_name").alias("p"), F.format_string('(nation (name ?n) (region (name "%s")))', "r_name").alias("t"))
    patterns = own.unionByName(spark.createDataFrame([("any", "(nation _*)"), ("all", "(_ ??rest)"), ("none", "(region _*)"), ("no", "(_)")], "p string, t string")).select("p", C.parse_sexp("t").alias("pattern"))
    return R.theta_join(S.ingested(spark, d, "nation").select("n_name", "sx"), patterns, "sx", "pattern", "match").select("n_name", "p")


@query("SELECT i, j, printf('(pair %d (of %d))', i, j) AS txt FROM generate_series(1, 20) a(i), LATERAL generate_series(1, i) b(j)")
def lateral_series(spark, d):
    rows = spark.sql("SELECT a.id AS i, j FROM range(1, 21) a, LATERAL explode(sequence(1L, a.id)) AS b(j)")
    return rows.select("i", "j", C.sexp_text(C.parse_sexp(F.format_string("(pair %d  (of %d))", "i", "j"))).alias("txt"))


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def cross_join(spark, d):
    """Two tables of fixed size, both as values."""
    left = S.ingested(spark, d, "nation").select(C.sexp_str("sx", (1, 1)).alias("n_name"))
    return left.crossJoin(S.read(spark, d, "region").select(C.sexp_str(C.parse_sexp(F.format_string('"%s"', "r_name"))).alias("r_name")))


@query("SELECT n_name, 4 AS lists, 4 AS symbols, 2 AS strings FROM nation")
def udtf_nodes(spark, d):
    """The table function over text, beside each row."""
    register(spark)
    S.ingested(spark, d, "nation").select("n_name", C.sexp_text("sx").alias("txt")).createOrReplaceTempView("arbolist_nations")
    return spark.sql("""SELECT n_name, cast(count_if(t.kind = 'list') AS INT) AS lists, cast(count_if(t.kind = 'symbol') AS INT) AS symbols, cast(count_if(t.kind = 'string') AS INT) AS strings
        FROM arbolist_nations, LATERAL sexp_nodes(txt) t GROUP BY n_name""")


@query("SELECT event_type AS t, count(*) AS n FROM events WHERE user_id < 100 GROUP BY 1")
def json_baseline(spark, d):
    """The same question to JSON text, as a measure to compare with."""
    js = S.read(spark, d, "events").select(F.to_json(F.struct(F.struct("event_type", "user_id").alias("event"))).alias("js"))
    rows = js.select(F.get_json_object("js", "$.event.event_type").alias("t"), F.get_json_object("js", "$.event.user_id").cast("long").alias("u"))
    return rows.where("u < 100").groupBy("t").agg(F.count("*").alias("n"))


@query("SELECT event_type AS t, count(*) AS n FROM events WHERE user_id < 100 GROUP BY 1")
def json_baseline_sexp(spark, d):
    return ev(spark, d).where(C.sexp_int("sx", (3, 1)) < 100).groupBy(C.sexp_str("sx", (2, 1)).alias("t")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, true AS stored, true AS smaller FROM events")
def storage_metrics(spark, d):
    """Bytes of the stored values, which are fewer than five times those of their texts."""
    rows = ev(spark, d)
    path = rows.inputFiles()[0].rsplit("/", 1)[0]
    text = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length(C.sexp_text("sx"))).alias("size"))
    return text.crossJoin(S.storage(spark, path)).select("n", (F.col("bytes") > 0).alias("stored"), (F.col("bytes") < 5 * F.col("size") + 100_000).alias("smaller"))


@query("SELECT count(*) AS n, sum(CASE WHEN event_type LIKE '%c%' THEN 1 ELSE 0 END) AS liked, sum(event_id % 7) AS rest, max(length(repeat('ab', cast(event_id % 5 AS INT)))) AS longest FROM events")
def expressions_on_values(spark, d):
    """LIKE, %, repeat and casts on typed values."""
    t, i = C.sexp_str("sx", (2, 1)), C.sexp_int("sx", (1,))
    return ev(spark, d).agg(F.count("*").alias("n"), F.sum(F.when(t.like("%c%"), 1).otherwise(0)).cast("decimal(38,0)").alias("liked"), F.sum(i % 7).cast("decimal(38,0)").alias("rest"), F.max(F.length(F.repeat(F.lit("ab"), (i % 5).cast("int")))).cast("long").alias("longest"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_join_on_key(spark, d):
    left = S.read(spark, d, "customer").select("c_custkey", C.parse_sexp(F.format_string("(cust %d)", "c_custkey")).alias("v"))
    return R.equi_join(left, orders(spark, d).select(C.nth("sx", 2).alias("w")), F.col("v"), F.col("w"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_on_key(spark, d):
    left = S.read(spark, d, "customer").select("c_custkey", C.parse_sexp(F.format_string("(cust %d)", "c_custkey")).alias("v"))
    return R.equi_join(left, orders(spark, d).select(C.nth("sx", 2).alias("w")), F.col("v"), F.col("w"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def outer_join_on_key(spark, d):
    left = S.read(spark, d, "customer").select("c_custkey", C.parse_sexp(F.format_string("(cust %d)", "c_custkey")).alias("v"))
    right = orders(spark, d).select("o_orderkey", C.nth("sx", 2).alias("w"))
    return R.equi_join(left, right, F.col("v"), F.col("w"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT u FROM (SELECT user_id AS u FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'view') EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase'")
def set_operations(spark, d):
    of = lambda t: ev(spark, d).where(C.sexp_contains("sx", f'(type "{t}")')).select(C.sexp_key(C.at_path("sx", (3,))).alias("k"))
    left = of("click").intersect(of("view")).exceptAll(of("purchase").distinct())
    return left.select(F.regexp_extract("k", r"\(user (-?[0-9]+)\)", 1).cast("long").alias("u"))


@query("SELECT event_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id FROM events WHERE user_id = 3")
def union_all(spark, d):
    rows = ev(spark, d)
    return rows.where(C.sexp_contains("sx", '"click"')).select("event_id").unionByName(rows.where(C.sexp_contains("sx", "(user 3)")).select("event_id"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ROLLUP (1, 2)")
def rollup_on_paths(spark, d):
    return orders(spark, d).rollup(C.sexp_str("sx", (3, 1)).alias("status"), C.sexp_str("sx", (4, 1)).alias("priority")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY CUBE (1, 2)")
def cube_on_paths(spark, d):
    return orders(spark, d).cube(C.sexp_str("sx", (3, 1)).alias("status"), C.sexp_str("sx", (4, 1)).alias("priority")).agg(F.count("*").alias("n"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events")
def window_rank_by_key(spark, d):
    return ev(spark, d).select("event_id", F.row_number().over(Window.partitionBy(C.sexp_key(C.nth("sx", 3))).orderBy("event_id")).alias("rn"))


@query(f"SELECT event_id, {CENTS} AS cents FROM events ORDER BY cents DESC, event_id LIMIT 10")
def topk(spark, d):
    return ev(spark, d).select("event_id", C.sexp_int("sx", (4, 1)).alias("cents")).orderBy(F.desc("cents"), "event_id").limit(10)


@query("SELECT user_id AS u, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks, count(*) AS n FROM events GROUP BY 1")
def conditional_aggregate(spark, d):
    return ev(spark, d).groupBy(C.sexp_int("sx", (3, 1)).alias("u")).agg(F.sum(F.when(C.sexp_contains("sx", '"click"'), 1).otherwise(0)).cast("decimal(38,0)").alias("clicks"), F.count("*").alias("n"))


@query("SELECT o_custkey AS cust, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS statuses FROM orders GROUP BY 1")
def string_aggregate(spark, d):
    rows = orders(spark, d).groupBy(C.sexp_int("sx", (2, 1)).alias("cust")).agg(F.sort_array(F.collect_list(F.struct(C.sexp_int("sx", (1,)).alias("o"), C.sexp_str("sx", (3, 1)).alias("s")))).alias("l"))
    return rows.select("cust", F.array_join("l.s", ",").alias("statuses"))


@query("SELECT count(*) AS n FROM events WHERE user_id = (SELECT max(user_id) FROM events)")
def scalar_subquery(spark, d):
    rows = ev(spark, d).select(C.sexp_int("sx", (3, 1)).alias("u"))
    return rows.join(rows.agg(F.max("u").alias("m")), F.col("u") == F.col("m")).agg(F.count("*").alias("n"))


@query("SELECT i AS id, printf('(item %d (data %d))', i, i * 10) AS txt FROM generate_series(1, 1000) t(i)")
def generated_items(spark, d):
    rows = spark.range(1, 1001).select("id", F.format_string("(item %d (data %d))", "id", F.col("id") * 10).alias("sx"))
    return S.parsed(rows).where(C.sexp_match("sx", "(item _ (data _))")).select("id", C.sexp_text("sx").alias("txt"))


@query("SELECT n_name, 2 AS lists FROM nation")
def lateral_nodes(spark, d):
    rows = S.ingested(spark, d, "nation").select("n_name", F.explode("sx.nodes").alias("n"), F.get("sx.nodes", F.lit(0))["c"].alias("c")).where("n.t = 'list' AND array_contains(c, n.id)")
    return rows.groupBy("n_name").agg(F.count("*").cast("int").alias("lists"))


@query("SELECT event_type AS t, count(*) AS n FROM events GROUP BY 1")
def sql_functions(spark, d):
    """The same over expression text in spark.sql()."""
    register(spark)
    S.read(spark, d, "events").select(S.events_text().alias("sx")).createOrReplaceTempView("arbolist_events")
    return spark.sql("""SELECT replace(nth(nth(sx, 2), 1), '"', '') AS t, count(*) AS n FROM arbolist_events
        WHERE sexp_contains_key(sx, '(event (type))') AND sexp_match(sx, '(event _*)') AND car(sx) = 'event' AND NOT is_nil(sx) AND sexp_find(sx, '(user _)') IS NOT NULL GROUP BY 1""")


# Streaming (section 2.10)
@query("SELECT date_trunc('hour', ts) AS hour, event_type AS t, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark, d):
    src = S.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = S.scratch(spark)
    src.repartition(4).write.parquet(f"{folder}/in")
    stream = W.read_stream(spark, f"{folder}/in", src.schema, files_per_trigger=2).withColumn("sx", S.events_text())
    counts = W.windowed_counts(stream, "ts", "sx", (2, 1))
    out = W.run_to_end(counts, scratch_name(), f"{folder}/checkpoint")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), F.replace("value", F.lit('"'), F.lit("")).alias("t"), "n")


@query("SELECT DISTINCT event_type AS t FROM events")
def stream_distinct_values(spark, d):
    """Each value once, within a watermark longer than the data."""
    src = S.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = S.scratch(spark)
    src.repartition(4).write.parquet(f"{folder}/in")
    stream = W.read_stream(spark, f"{folder}/in", src.schema, files_per_trigger=2).withColumn("sx", F.format_string('(type   "%s")', "event_type"))
    out = W.run_to_end(W.distinct_within(stream, "ts", "sx", "9999 days").select(C.sexp_str("sx", (1,)).alias("t")), scratch_name(), f"{folder}/checkpoint", "append")
    return out.select("t")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Clicks by user: a key containment filter and a grouping by value."""
    hits = ev(spark, d).where(C.sexp_contains_key("sx", '(event (type "click"))'))
    return R.group_by_sexp(hits, C.nth("sx", 3), F.count("*").alias("n"), name="who")
