"""Personal data, with DataFrame functions only: patterns for protected entities, and terms that give entities away.

Four kinds of entity are found by pattern: e-mail and IP addresses, card and phone numbers. What is protected is each entity
and each kind (so that entities of one document count through what their kind has in common). The terms of a text are its
words outside of entities: of four letters or more, with a digit, or short and written as names are (TERM). Over the whole
corpus and whole texts are counted, in documents: n_e with an entity, n_t with a term, n_both with both; and n, the distinct
texts with both, as copies are no further evidence. A term discloses an entity to the extent

    PMI(entity, term) / IC(entity)   =   log(p(e | t) / p(e)) / -log p(e),    p(e | t) = n_both / n_t * n / (n + PRIOR)

which is near 1 where the term alone points to the entity; the smoothed p(e | t) asks for the more texts the commoner the
entity is, and counts entities of one text too. (One text is enough from 1,024 documents on: there, a word of one document
points to each entity of that document.) Terms with a disclosure of at least THRESHOLD are spans too (kind `term`),
wherever they stand outside of entities in documents with that entity; sanitise() removes entities and generalises terms to
their kind.

Counts are taken per document before any shuffle, and are pre-aggregated per task, so that an entity or a word that a third
of all documents share is a row for each task. Entities of the same texts have the same counts and are one key. Words that
no entity can reach are dropped before they are paired. What documents disclose is joined back by a hash of the text, to the
documents with entities alone. Words are compared by 64-bit hashes.

Defined results: null and empty texts have no span; offsets are code points, ends exclusive; repeated texts get the same
spans; other columns pass through in sanitise(), and are ignored in find().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, shared_dir, written
from .quality_rules import let

#: Possessive quantifiers and the look-behinds keep the time in proportion to the text; they match what the plain forms
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and so on match, leftmost and without overlap (\G: after the last match).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
KINDS = ("email", "ip", "card", "phone")
WORD = r"[\p{L}\p{N}]++"
#: Words that can be terms: with a digit, of four letters or more, or of two or three with a capital or of a script without case.
TERM = r"(?<![\p{L}\p{N}])(?:(?=\p{L}*+\p{N})[\p{L}\p{N}]{2,}+|\p{L}{4,}+|\p{Lu}\p{L}{1,2}+|\p{Lo}{2,3}+)(?![\p{L}\p{N}])"
PRIOR, THRESHOLD = 1.0, 0.9
#: Words (of 8 bytes) that may be broadcast; with more, all are counted.
FEW = 1_000_000
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""

    def weigh(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return let(F.regexp_replace(value, "[ -]", ""), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def folded(items: Column, out: str, step: Callable[[Column, Column], Column]) -> Column:
    """What step(at, item) puts out for each item, as an array; step gives a struct of the next `at` and of `out`, null to put out none.

    Appending copies what is there, so items are taken in runs of about the root of their number, each with an array of its own.
    """
    inner, outer = f"struct<at:int,out:array<{out}>>", f"struct<at:int,out:array<array<{out}>>>"

    def add(acc: Column, x: Column) -> Column:
        return let(step(acc["at"], x), lambda s: F.struct(s["at"].alias("at"), F.when(s["out"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(s["out"]))).alias("out")).cast(inner))

    def add_run(acc: Column, run: Column) -> Column:
        part = F.aggregate(run, F.struct(acc["at"].alias("at"), F.array().cast(f"array<{out}>").alias("out")).cast(inner), add)
        return let(part, lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], F.array(p["out"])).alias("out")).cast(outer))

    def runs(xs: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs))).cast("int"))
        return let(size, lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(xs) / n).cast("int") - 1)), lambda i: F.slice(xs, i * n + 1, n)))

    return let(items, lambda xs: F.aggregate(runs(xs), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{out}>>").alias("out")).cast(outer), add_run, lambda a: F.flatten(a["out"])))


def placed(text: Column, pattern: Column, kind: str, good: Callable[[Column], Column]) -> Column:
    """Spans of a pattern's matches: what lies between matches gives their places."""
    span = "struct<kind:string,start:int,end:int,value:string>"

    def step(at: Column, x: Column) -> Column:
        begin = at + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        one = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["hit"].alias("value")).cast(span)
        return F.struct(end.alias("at"), F.when(good(x["hit"]), one).alias("out"))

    pairs = lambda hits: F.zip_with(hits, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    found = let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda hits: folded(pairs(hits), span, step))
    return F.when(F.regexp_like(text, pattern), found).otherwise(F.array().cast(SPAN))


def with_entities(docs: DataFrame) -> DataFrame:
    """(row, none, t, e): the columns of docs but the text, whether the text is null, the text, and its entities' spans by kind and then by start.

    The columns are in a struct, so that none of them clashes with a name used here.
    """
    own = [col(c) for c in docs.columns if c != "text"]
    out = docs.select((F.struct(*own) if own else F.lit(None)).alias("row"), F.col("text").isNull().alias("none"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    t = F.col("t")
    return out.withColumn("e", F.concat(*(placed(t, F.lit(p), k, lambda v, k=k: valid(k, v)) for k, p in zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))))


def entity(span: Column) -> Column:
    """An entity's key: its kind and its characters without layout, as a hash."""
    return F.xxhash64(span["kind"], F.lower(F.regexp_replace(span["value"], r"[^A-Za-z0-9@.]", "")))


def replaced(text: Column, spans: Column, put: Callable[[Column], Column]) -> Column:
    """The text with put(span) in place of each span; a span that begins within the one before gives way to it."""

    def step(at: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, at + 1, s["start"] - at), put(s))
        return F.struct(F.greatest(at, s["end"]).alias("at"), F.when(s["start"] >= at, F.struct(piece.alias("s"), s["end"].alias("end"))).alias("out"))

    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("to"), s["end"].alias("end"), s["kind"].alias("kind"))))
    pieces = folded(by_start, "struct<s:string,end:int>", step)
    return let(pieces, lambda p: F.when(F.size(p) == 0, text).otherwise(F.concat(F.array_join(p["s"], ""), F.substring(text, F.get(p, F.size(p) - 1)["end"] + 1, F.length(text)))))


def merged(spans: Column) -> Column:
    """Spans as stretches without overlap."""

    def step(at: Column, s: Column) -> Column:
        return F.struct(F.greatest(at, s["end"]).alias("at"), F.when(s["end"] > at, F.struct(F.lit("").alias("kind"), F.greatest(at, s["start"]).alias("start"), s["end"].alias("end"))).alias("out"))

    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return folded(by_start, "struct<kind:string,start:int,end:int>", step)


def blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of the spans' characters."""
    return replaced(text, merged(spans), lambda s: F.repeat(F.lit(" "), s["end"] - s["start"]))


def word(x: Column) -> Column:
    return F.xxhash64(F.lower(x))


def terms_of(text: Column, pattern: str = TERM) -> Column:
    """The distinct words of a text that a pattern finds, as hashes."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), word))


def disclosing(docs: DataFrame, folder: str, threshold: float = THRESHOLD) -> DataFrame:
    """(h, terms): for a text's hash the hashes of the terms that disclose an entity of that text, from counts over all documents."""
    texts = docs.select("text")
    total = float(docs.count())
    own = with_entities(texts).where(F.size("e") > 0).select(F.xxhash64("t", F.lit(1)).alias("h"), F.array_distinct(F.transform("e", entity)).alias("es"), F.array_distinct(F.transform("e", lambda s: s["kind"])).alias("kinds"), terms_of(blanked(F.col("t"), F.col("e"))).alias("ts"))  # no texts
    own = written(own.groupBy("h").agg(F.count("*").alias("m"), *(F.first(c).alias(c) for c in ("es", "kinds", "ts"))), f"{folder}/entities")
    # Keys: entities by the texts that hold them, and kinds; each with its number of documents.
    held = own.select("h", "m", F.explode("es").alias("e"))
    sets = held.groupBy("e").agg(F.xxhash64(F.count("*"), F.bit_xor("h")).alias("k"), F.sum("m").alias("n_e"))
    keys = held.join(sets, "e").groupBy("h").agg(F.collect_set(F.struct("k", "n_e")).alias("ks"))
    n_kind = own.agg(*(F.coalesce(F.sum(F.when(F.array_contains("kinds", k), F.col("m"))), F.lit(0)).alias(k) for k in KINDS)).first()
    kinds = F.filter(F.array(*(F.struct(F.xxhash64(F.lit(k)).alias("k"), F.lit(n_kind[k]).cast("long").alias("n_e"), F.lit(k).alias("kind")) for k in KINDS)), lambda x: F.array_contains("kinds", x["kind"]))
    # Words that may disclose: an entity of one document has the least probability, and asks for the smallest p(e | t).
    at = own.select("h", "m", F.explode("ts").alias("t"))
    beside = written(at.groupBy("t").agg(F.sum("m").alias("n_both"), F.count("*").alias("n")), f"{folder}/beside")
    words = texts.select(F.explode(terms_of(F.coalesce(F.col("text").cast("string"), F.lit("")), WORD)).alias("t"))
    # Only words beside an entity are needed: others are dropped before the shuffle where these are few enough to send to every
    # task, and else after it, counted per task before.
    if beside.count() <= FEW:
        words = words.join(F.broadcast(beside.select("t")), "t", "left_semi")
    n_t = words.groupBy("t").agg(F.count("*").alias("n_t"))
    given = F.col("n_both") / F.col("n_t") * F.col("n") / (F.col("n") + PRIOR)
    may = n_t.join(beside, "t").where(given >= max(1.0, total) ** (threshold - 1) * (1 - 1e-9)).select("t", "n_t")
    least = lambda n_e: F.pow(n_e / total, F.lit(1 - threshold)) * (1 - 1e-9)
    reach = F.filter(F.concat("ks", F.transform(kinds, lambda x: F.struct(x["k"].alias("k"), x["n_e"].alias("n_e")))), lambda x: (x["n_e"] < total) & (F.least(x["n_e"], F.col("n_t")) / F.col("n_t") >= least(x["n_e"])))
    pairs = at.join(may, "t").join(keys.join(own.select("h", "kinds"), "h"), "h").select("h", "m", "t", "n_t", F.explode(reach).alias("x")).select("h", "m", "t", "n_t", "x.*")
    pairs = written(pairs, f"{folder}/pairs")
    found = pairs.groupBy("k", "t").agg(F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"), F.sum("m").alias("n_both"), F.count("*").alias("n")).where(given >= least(F.col("n_e"))).select("k", "t")
    return pairs.select("h", "k", "t").join(found, ["k", "t"]).groupBy("h").agg(F.array_sort(F.collect_set("t")).alias("terms"))


def with_spans(docs: DataFrame, folder: str) -> DataFrame:
    """(row, none, t, e, s) as with_entities() gives, and s: all spans, terms last. Only documents with entities are dealt out to be joined."""
    told = written(disclosing(docs, folder), f"{folder}/told")
    out = with_entities(docs)
    some = out.where(F.size("e") > 0).withColumn("h", F.xxhash64("t", F.lit(1))).join(told, "h", "left")
    more = placed(blanked(F.col("t"), F.col("e")), F.lit(WORD), "term", lambda x: F.array_contains("terms", word(x)))
    some = some.withColumn("s", F.when(F.size("terms") > 0, F.concat("e", more)).otherwise(F.col("e"))).select("row", "none", "t", "e", "s")
    return out.where(F.size("e") == 0).withColumn("s", F.col("e")).unionByName(some)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the number of entities of each kind, base_sha256 and spans (both over kind:start:end lists) for every document."""
    rows = with_spans(docs.select("doc_id", "text"), shared_dir(docs.sparkSession))
    count = [F.size(F.array_remove(F.transform("e", lambda s: s["kind"] != kind), F.lit(True))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return rows.select(F.col("row")["doc_id"].alias("doc_id"), *count, F.sha2(listed(F.col("e")).cast("binary"), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with entities removed and disclosing terms generalised in `text`, and `n_chars`, if there, counted anew.

    Each span's kind stands in its place. The columns are those of docs, whatever their names and types.
    """
    rows = with_spans(docs, shared_dir(docs.sparkSession))
    found = F.size("s") > 0
    rows = rows.withColumn("clean", F.when(found, replaced(F.col("t"), F.col("s"), lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))))

    def final(name: str) -> Column:
        if name == "text":
            return F.coalesce(F.col("clean"), F.when(~F.col("none"), F.col("t"))).alias(name)
        own = F.col("row").getField(name)
        if name == "n_chars":
            own = F.when(found, F.length("clean").cast(docs.schema[name].dataType)).otherwise(own)
        return own.alias(name)

    return rows.select(*map(final, docs.columns))
