"""Column forms against the plain evaluator, plans, index, SQL names, sinks and streams."""

import random

import pytest
from pyspark.sql import functions as F

from arbolist.functions import columns as C
from arbolist.functions import sexp as S
from arbolist.functions.register import register
from arbolist.operators import index as I
from arbolist.operators import relational as R
from arbolist.plans.compile import prefilter
from arbolist.sources import tables as T


def tree(r, depth=0):
    if depth > 3 or r.random() < 0.35:
        return r.choice(["a", "b", "f", "1", "2", "1.0", '"s"', "()", '"a\\"b"', "nil"])
    return "(" + " ".join(tree(r, depth + 1) for _ in range(r.randint(0, 4))) + ")"


@pytest.fixture(scope="module")
def trees(spark):
    r = random.Random(3)
    texts = [tree(r) for _ in range(150)] + ["", "(a b)", "(f 1 (a b))", "(f (a 1) (b 2))"]
    df = T.parsed(spark.createDataFrame(list(enumerate(texts)), "id int, sx string"), keep_text=True).cache()
    return df, texts


NEEDLES = ["a", "()", '"s"', "1", "1.0", "(a b)", "(f 1)", "(a)", "(f (a 1))", "(f (b 2) (a 1))", "(a (b (f 1)))", "(f (a (b (a (f 1)))))"]
PATTERNS = ["_", "_*", "(_ _)", "(f _*)", "(a ?x)", "(_ (_ _*) _*)", "(f (a ?v) (b _))", "(_* a)", "a", "(??all)"]


@pytest.mark.parametrize("q", NEEDLES)
def test_containment(trees, q):
    df, texts = trees
    got = {r["id"]: (r["c"], r["k"]) for r in df.select("id", C.sexp_contains("sx", q).alias("c"), C.sexp_contains_key("sx", q).alias("k")).collect()}
    want = {i: (S.contains(S.parse(t), S.parse(q)), S.contains_key(S.parse(t), S.parse(q))) for i, t in enumerate(texts)}
    assert got == want
    lost = df.where(C.sexp_contains("sx", q) & ~prefilter(F.col("sx.key"), q) | C.sexp_contains_key("sx", q) & ~prefilter(F.col("sx.key"), q, by_key=True))
    assert lost.count() == 0


def test_needle_columns(stored, spark):
    """Stored needles, beside values of another column; shallow and deep ones."""
    needles = T.parsed(spark.createDataFrame(list(enumerate(NEEDLES)), "q int, sx string")).withColumnRenamed("sx", "needle")
    rows = stored.select("id", "sx").crossJoin(needles)
    got = {(r["id"], r["q"]): (r["c"], r["k"]) for r in rows.select("id", "q", C.sexp_contains("sx", F.col("needle")).alias("c"), C.sexp_contains_key("sx", F.col("needle")).alias("k")).collect()}
    texts = {r["id"]: r["t"] for r in stored.select("id", C.sexp_key("sx").alias("t")).collect()}
    assert got == {(i, k): (S.contains(S.from_key(t), S.parse(q)), S.contains_key(S.from_key(t), S.parse(q))) for i, t in texts.items() for k, q in enumerate(NEEDLES)}


@pytest.mark.parametrize("p", PATTERNS)
def test_patterns(trees, p):
    df, texts = trees
    got = {r["id"]: (r["m"], r["f"], r["all"]) for r in df.select("id", C.sexp_match("sx", p).alias("m"), C.sexp_text(C.sexp_find("sx", p)).alias("f"), C.sexp_find_all("sx", p).alias("all")).collect()}
    for i, t in enumerate(texts):
        x, y = S.parse(t), S.parse(p)
        f = S.find(x, y)
        assert got[i] == (S.matches(x, y), f.txt if f else None, [n.txt for n in S.find_all(x, y)])


def test_navigation(trees):
    df, texts = trees
    cols = {"car": C.sexp_text(C.car("sx", strict=False)), "cdr": C.sexp_text(C.cdr("sx", strict=False)), "cdr2": C.sexp_text(C.cdr(C.cdr("sx", strict=False), strict=False)), "nth": C.sexp_key(C.nth("sx", 1)), "len": C.sexp_length("sx"), "path": C.sexp_key(C.sexp_path("sx", (1, 0)))}
    for r in df.select("id", *(c.alias(n) for n, c in cols.items())).collect():
        x = S.parse(texts[r["id"]])
        is_list = x.t in ("list", "nil")
        cdr = S.rest(x) if is_list else None
        cdr2 = S.rest(cdr) if cdr is not None else None
        two = S.element(x, 1)
        path = S.element(two, 0) if two is not None else None
        text = lambda n: n.txt if n is not None else None
        assert (r["car"], r["cdr"], r["cdr2"], r["len"]) == (text(S.first(x)) if is_list else None, text(cdr), text(cdr2), S.length(x))
        assert (r["nth"], r["path"]) == (two.key if two is not None else None, path.key if path is not None else None)


def test_cut_subtrees_are_whole_values(trees):
    df, _ = trees
    rows = df.select(C.cdr("sx", strict=False).alias("x"), C.nth("sx", 1).alias("y")).select(*(F.col(c) for c in "xy"), *(C.try_parse_sexp(C.sexp_text(c)).alias("p" + c) for c in "xy"))
    for r in rows.collect():
        for c in "xy":
            if r[c] is None or any(n["t"] == "float" for n in r[c]["nodes"]):
                continue  # texts of floats are no literals of the same value
            assert r[c] == r["p" + c]


def test_errors_and_nulls(spark):
    one = spark.createDataFrame([("a",)], "x string").select(C.parse_sexp("x").alias("x"))
    with pytest.raises(Exception, match="car requires a list"):
        one.select(C.car("x")).collect()
    with pytest.raises(Exception, match="unterminated"):
        spark.createDataFrame([("(a",)], "x string").select(C.parse_sexp("x")).collect()
    null = spark.createDataFrame([(None,)], "x string").select(C.parse_sexp("x").alias("x"))
    got = null.select(C.sexp_text("x"), C.is_nil("x"), C.sexp_length("x"), C.sexp_hash("x"), C.car("x"), C.nth("x", 0), C.sexp_contains("x", "a"), C.sexp_contains_key("x", "(a b)"), C.sexp_match("x", "_"), C.sexp_find("x", "_")).first()
    assert all(v is None for v in got)


def test_accessors(spark):
    df = T.parsed(spark.createDataFrame([('(rec (name "a\\\\n\\"b\\n") (n 5) (x 1.5) (n 6))',)], "sx string"))
    nul = spark.createDataFrame([('"a\0b\\\\\\n\\\\n\\"\\\\"',)], "x string").select(C.sexp_str(C.parse_sexp("x"))).first()[0]
    assert nul == 'a\0b\\\n\\n"\\'
    got = df.select(C.sexp_str("sx", (1, 1)).alias("s"), C.sexp_int("sx", (2, 1)).alias("i"), C.sexp_float("sx", (3, 1)).alias("d"), C.sexp_to_map("sx").alias("m"), C.sexp_captures("sx", "(rec (name ?n) ??r)").alias("c")).first()
    assert (got["s"], got["i"], got["d"]) == ('a\\n"b\n', 5, 1.5)
    assert got["m"]["n"] == "6" and got["c"]["r"] == "((n 5) (x 1.5) (n 6))"


def test_cut_subtrees_with_floats(spark):
    df = T.parsed(spark.createDataFrame([("(a (b 1.5 (c 2.0)) (d 3) 4.25)",)], "sx string"))
    cuts = {"(b 1.5 (c 2.0))": C.nth("sx", 1), "(c 2.0)": C.nth(C.nth("sx", 1), 2), "(d 3)": C.nth("sx", 2), "((d 3) 4.25)": C.cdr(C.cdr("sx")), "((b 1.5 (c 2.0)) (d 3) 4.25)": C.cdr("sx"), "(1.5 (c 2.0))": C.cdr(C.car(C.cdr("sx"))), "()": C.cdr(C.cdr(C.nth("sx", 2)))}
    got = df.select(*(c.alias(f"c{k}") for k, c in enumerate(cuts.values()))).first()
    for r, t in zip(got, cuts, strict=True):
        assert r.asDict(recursive=True) == S.value(S.parse(t))
    assert df.select(C.cdr(C.cdr(C.cdr(C.nth("sx", 2)))).alias("x")).first()["x"] is None


def chained(kind, depth):
    x = F.col("sx")
    for k in range(depth):
        x = {"nth": lambda x: C.nth(x, 1), "car": C.car, "cdr": C.cdr, "mixed": lambda x, k=k: C.car(C.cdr(x)) if k % 2 else C.nth(x, 2)}[kind](x)
    return C.sexp_key(x)


@pytest.mark.parametrize("kind", ["nth", "car", "cdr", "mixed"])
def test_chains_are_linear_in_plan_and_right(spark, tmp_path, kind):
    T.parsed(spark.createDataFrame([("(a (b (c (d (e f)))) (g (h i) (j k)) l)",)], "sx string")).write.parquet(f"file://{tmp_path}/t")
    stored = spark.read.parquet(f"file://{tmp_path}/t")
    size = [len(stored.select(chained(kind, n).alias("v"))._jdf.queryExecution().optimizedPlan().toString()) for n in (2, 4, 8, 16)]
    assert size[3] - size[2] < 3 * (size[2] - size[1]) + 200 and size[3] < 12_000
    x, want = S.parse("(a (b (c (d (e f)))) (g (h i) (j k)) l)"), {}
    got = stored.select(*(C.sexp_key(c).alias(n) for n, c in {"p": C.nth(C.nth(C.nth("sx", 1), 1), 1), "q": C.car(C.cdr(C.nth(C.cdr(C.cdr("sx")), 0))), "r": C.cdr(C.cdr(C.cdr("sx")))}.items())).first()
    want = (S.element(S.element(S.element(x, 1), 1), 1).key, S.first(S.rest(S.element(x, 2))).key, S.rest(S.rest(S.rest(x))).key)
    assert tuple(got) == want


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture(scope="module")
def stored(trees, spark, tmp_path_factory):
    df, _ = trees
    path = f"file://{tmp_path_factory.mktemp('t')}/t"
    df.drop("sx_text").write.parquet(path)
    return spark.read.parquet(path)


def test_plans(stored):
    """What EXPLAIN shows: filters and columns reach the scan, joins are hash or merge joins, and generated code has the chains."""
    own = plan(stored.where(C.sexp_contains("sx", "(a b)")).select("id"))
    assert "StringContains(sx.key,(a b))" in own
    by_key = plan(stored.where(C.sexp_contains_key("sx", "(f (b 2) (a 1))")).select("id"))
    assert all(f"StringContains(sx.key,{k})" in by_key for k in "fba21")
    fitted = plan(stored.where(C.sexp_match("sx", "(f (a ?v) _*)")).select("id"))
    assert "StringContains(sx.key,f)" in fitted and "StringContains(sx.key,a)" in fitted
    assert "ReadSchema: struct<sx:struct<key:string>>" in plan(stored.groupBy(C.sexp_key("sx")).count())
    equal = plan(R.equi_join(stored, stored.select(F.col("sx").alias("o")), F.col("sx"), F.col("o")))
    assert "Cartesian" not in equal and "NestedLoop" not in equal
    for by in ("contains", "contains_key", "match"):
        theta = plan(R.theta_join(stored, stored.select(F.col("sx").alias("needle")).limit(3), "sx", "needle", by))
        assert "Cartesian" not in theta and "NestedLoop" not in theta and "Python" not in theta.split("Project")[0] + ("" if by != "contains" else theta)
    assert "WholeStageCodegen" in plan(stored.select(C.car(C.cdr(C.nth("sx", 1))).field("t")), "codegen")


def test_index_reads_one_directory_and_few_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "RANGES", 2)
    rows = spark.range(0, 20000, 1, 8).select("id", F.format_string("(row %d (kind k%d))", "id", F.col("id") % 3).alias("sx"))
    values = T.store(rows, f"file://{tmp_path}/v")
    index = I.write_index(values, f"file://{tmp_path}/i")
    own = plan(I.ids_for(index, "(row 777)", by_key=True))
    assert "PartitionFilters: [" in own and "EqualTo(key,a777)" in own
    hit = I.lookup(values, index, "(row 777)", by_key=True)
    assert [r["id"] for r in hit.select("id").collect()] == [777] and "EqualTo(id,777)" in plan(hit)
    assert I.ids_for(index, "(row 777)", by_key=True).count() == 1 and I.ids_for(index, "(kind k1)", most=100) is None
    two = I.in_ranges("id", [3, 4, 900, 5])
    assert values.where(two).count() == 4 and "id#" in plan(values.where(two)) and "LessThanOrEqual(id,5)" in plan(values.where(two)) and "EqualTo(id,900)" in plan(values.where(two))
    assert I.lookup(values, index, "(kind k9)").count() == 0
    assert I.lookup(values, index, "(kind k1)").count() == 6667
    hashed = I.write_hash_index(values, f"file://{tmp_path}/h", C.nth("sx", 2))
    assert I.ids_equal(hashed, "(kind k2)").count() == 6666 and "EqualTo(key,(kind k2))" in plan(I.ids_equal(hashed, "(kind  k2)"))
    I.bucketed(values, "bucketed_values", 4, C.nth("sx", 2))
    t = spark.table("bucketed_values")
    assert "Exchange" not in plan(t.groupBy("sx_key").count()) and t.groupBy("sx_key").count().count() == 3
    spark.sql("DROP TABLE bucketed_values")


@pytest.mark.parametrize(("q", "by_key"), [("(a b)", False), ("(f (a 1))", True), ("a", False)])
def test_index(trees, tmp_path, q, by_key):
    df, texts = trees
    index = I.write_index(df, f"file://{tmp_path}/i")
    got = sorted(r["id"] for r in I.lookup(df, index, q, by_key).select("id").collect())
    f = S.contains_key if by_key else S.contains
    assert got == [i for i, t in enumerate(texts) if f(S.parse(t), S.parse(q))]


@pytest.mark.parametrize(("by", "test", "needles"), [("contains", S.contains, NEEDLES), ("contains_key", S.contains_key, NEEDLES), ("match", S.matches, PATTERNS)])
def test_theta_joins(trees, spark, by, test, needles):
    df, texts = trees
    own = spark.createDataFrame([(q,) for q in needles], "q string").withColumn("needle", C.parse_sexp("q"))
    got = sorted((r["id"], r["q"]) for r in R.theta_join(df.select("id", "sx"), own, "sx", "needle", by).collect())
    assert got == sorted((i, q) for i, t in enumerate(texts) for q in needles if test(S.parse(t), S.parse(q)))


def test_sql_names(spark):
    names = register(spark)
    assert {"car", "cdr", "nth", "sexp_contains", "sexp_match", "sexp_nil"} <= set(names)
    got = spark.sql("""SELECT car('(a b)') a, cdr('(a)') b, nth('(a b)', 1) c, sexp_length('()') d, sexp_typeof('1e5') e, sexp_contains('(a (b c))', '(b c)') f, sexp_contained('a', '(a)') g,
        sexp_contains_key('(+ 1 2 3)', '(+ 2 1)') h, sexp_match('(f 1)', '(f _)') i, sexp_find('(a (f 1))', '(f _)') j, sexp_eq('-0.0', '0.0') k, sexp_ne('1', '1.0') l, sexp_nil() m,
        sexp_hash('(a)') = sexp_hash('( a )') n, sexp_hash_extended('(a)', 0L) = sexp_hash('(a)') o, is_number('3') p, sexp_recv(sexp_send('(a  b)')) q, try_car('x') r, sexp_hash('()') s, car(NULL) t, sexp_contained_key('(b)', '(a (b c))') u, sexp_captures('(f 1 2)', '(f ?x ??y)')['y'] v""").first()
    assert tuple(got) == ("a", "()", "b", 0, "symbol", True, True, True, True, "(f 1)", True, True, "()", True, True, True, "(a b)", None, 0, None, True, "(2)")
    one = spark.createDataFrame([("(a  1.50)",), ("()",), (None,)], "t string")
    both = one.select(C.sexp_hash(C.parse_sexp("t")).alias("a"), F.expr("sexp_hash(t)").alias("b"), C.sexp_hash_extended(C.parse_sexp("t"), 7).alias("c"), F.expr("sexp_hash_extended(t, 7)").alias("d"))
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in both.collect())
    nodes = spark.sql("SELECT n.* FROM VALUES ('(a (b 1))'), (NULL) v(t), LATERAL sexp_nodes(t) n").collect()
    assert [tuple(r) for r in nodes] == [(0, None, 0, "list", "(a (b 1))"), (1, 0, 0, "symbol", "a"), (2, 0, 1, "list", "(b 1)"), (3, 2, 0, "symbol", "b"), (4, 2, 1, "integer", "1")]


def test_text_sink(trees, spark, tmp_path):
    df, texts = trees
    T.write_text(df.where(~F.col("sx_text").contains("1.0")), f"file://{tmp_path}/out")
    back = T.read_text(spark, f"file://{tmp_path}/out")
    assert sorted(r[0] for r in back.select("sx.key").collect()) == sorted(S.parse(t).key for t in texts if "1.0" not in t)
