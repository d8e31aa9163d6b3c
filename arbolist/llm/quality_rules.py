"""Quality rules as weak supervision, with DataFrame functions only.

Each rule votes good (1) or bad (-1) on a document, or abstains (0). Expectation-maximisation over the counts of the vote
patterns (at most 3 ** number of rules rows, whatever the corpus) estimates, for good and for bad documents, how often each
rule gives each vote; the posterior probability that a document is good replaces the demand that it pass every rule.
Two base conditions (too few words, too many repeated windows) still reject by themselves.

All counts are taken within a row, over the whole text: no shuffle but the one of the pattern counts. Windows of words are
compared by 64-bit hashes. Space is U+0020 and U+0009 to U+000D.

Defined results: null and empty texts have no words, fail the base and are not kept; equal texts get equal verdicts; a
corpus without rows has the starting estimates; other columns pass through in keep(), and are ignored in judge().
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_stops", "n_lines")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_words(hashes: Column) -> Column:
    """Words in windows that are found twice or more, from the hashes of a text's words."""

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, F.lit(1), F.size(h) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW))))

    def covered(g: Column) -> Column:
        by_hash = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(by_hash, lambda p: F.filter(F.transform(p, lambda s, j: F.when((s["x"] == F.get(p, j - 1)["x"]) | (s["x"] == F.get(p, j + 1)["x"]), s["i"])), lambda i: i.isNotNull()))
        ends = let(F.sort_array(twice), lambda q: F.transform(q, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(q, k + 1) - v, F.lit(WINDOW)))))
        return F.aggregate(ends, F.lit(0), lambda a, n: a + n)

    many = let(windows(hashes), lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(0))
    return F.when(F.size(hashes) > WINDOW, many).otherwise(0)


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of FEATURES (long), in a struct `_f`, so that no column of docs clashes with them."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    body = F.btrim(t, F.lit(SPACES))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = docs.withColumns({"_h": F.transform(words, lambda w: F.xxhash64(w)), "_l": lines, "_t": t})
    n = lambda c: F.length(F.col("_t")) - F.length(without(F.col("_t"), c))
    counts = {
        "n_words": F.size("_h"), "word_chars": F.length(without(F.col("_t"), SPACES)), "n_symbols": n(SYMBOLS), "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": repeated_words(F.col("_h")), "n_upper": n("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_stops": n(".?"), "n_lines": F.size("_l"),
    }
    return out.withColumn("_f", F.struct(*(counts[k].cast("long").alias(k) for k in FEATURES))).drop("_h", "_l", "_t")


def features(text: Column) -> Column:
    """The struct `_f` of with_features() as one expression, in which everything is evaluated once wherever it is put.

    A filter on columns would be pushed below the projection that makes them, and make them anew for each mention.
    """

    def count(t: Column, h: Column, lines: Column) -> Column:
        n = lambda c: F.length(t) - F.length(without(t, c))
        values = (F.size(h), F.length(without(t, SPACES)), n(SYMBOLS), F.size(lines) - F.size(F.array_distinct(lines)), repeated_words(h), n("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n(".?"), F.size(lines))
        return F.struct(*(v.cast("long").alias(k) for k, v in zip(FEATURES, values, strict=True)))

    def words(body: Column) -> Column:
        return F.when(body == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)))

    def lines(t: Column) -> Column:
        return F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    return let(F.coalesce(text.cast("string"), F.lit("")), lambda t: let(let(F.btrim(t, F.lit(SPACES)), words), lambda h: let(lines(t), lambda x: count(t, h, x))))


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules(f: Column) -> dict[str, Column]:
    """Each rule's vote. Shares are compared without division, so that empty texts need no care.

    Rules that look for one kind of fault abstain where they find none: its absence says little.
    """
    words, chars, never = f["n_words"], f["word_chars"], F.lit(False)
    return {
        "length": vote(words < 10, words >= 30),
        "word_size": vote((chars < 2 * words) | (chars > 14 * words), (chars >= 3 * words) & (chars <= 10 * words)),
        "sentences": vote(never, (40 * f["n_stops"] >= words) & (2 * f["n_stops"] <= words)),
        "symbols": vote((f["n_symbols"] >= 5) & (10 * f["n_symbols"] > words), never),
        "symbol_chars": vote((f["n_symbols"] >= 5) & (25 * f["n_symbols"] > chars), never),
        "lines": vote((f["n_dup_lines"] >= 2) & (10 * f["n_dup_lines"] > 3 * f["n_lines"]), never),
        "repeats": vote(100 * f["n_repeat_words"] > 15 * words, never),
        "capitals": vote(10 * f["n_upper"] > 4 * chars, never),
    }


@dataclass
class Votes:
    """prior: of a good document; p[rule][vote]: (among good, among bad)."""

    prior: float
    p: dict[str, dict[int, tuple[float, float]]]


def start(names: list[str]) -> Votes:
    """Before any data: a vote for bad is rare among good documents."""
    return Votes(0.85, {r: {1: (0.7, 0.5), 0: (0.285, 0.25), -1: (0.015, 0.25)} for r in names})


def log_odds(model: Votes, pattern: dict[str, int]) -> float:
    return math.log(model.prior / (1 - model.prior)) + sum(math.log(model.p[r][v][0] / model.p[r][v][1]) for r, v in pattern.items())


def estimate(counts: list[tuple[dict[str, int], int]], names: list[str], rounds: int = 100, weight: float = 0.02) -> Votes:
    """Expectation-maximisation from (pattern, count) rows. The start counts as a share `weight` of the rows, which keeps good from becoming bad."""
    first = model = start(names)
    total = sum(n for _, n in counts)
    for _ in range(rounds if total else 0):
        post = [(p, n, 1 / (1 + math.exp(-max(-500.0, min(500.0, log_odds(model, p)))))) for p, n in counts]
        good = sum(n * q for _, n, q in post)
        own = weight * total
        table = {}
        for r in names:
            sums = {v: [own * first.p[r][v][0], own * first.p[r][v][1]] for v in (1, 0, -1)}
            for p, n, q in post:
                sums[p[r]][0] += n * q
                sums[p[r]][1] += n * (1 - q)
            table[r] = {v: (a / (good + own), b / (total - good + own)) for v, (a, b) in sums.items()}
        new = Votes((good + own * first.prior) / (total + own), table)
        moved = max([abs(new.prior - model.prior), *(abs(new.p[r][v][k] - model.p[r][v][k]) for r in names for v in (1, 0, -1) for k in (0, 1))])
        model = new
        if moved < 1e-10:
            break
    return model


def fit(with_f: DataFrame) -> Votes:
    """Estimates from the vote patterns' counts over all rows."""
    f = rules(F.col("_f"))
    names = list(f)
    rows = with_f.select(*(c.alias(r) for r, c in f.items())).groupBy(*names).agg(F.count("*").alias("_n")).collect()  # at most 3 ** 8 rows
    return estimate(sorted(((({r: x[r] for r in names}), x["_n"]) for x in rows), key=lambda x: tuple(x[0].values())), names)


def posterior(f: Column, model: Votes) -> Column:
    z = F.lit(math.log(model.prior / (1 - model.prior)))
    for r, v in rules(f).items():
        ratio = {k: math.log(a / b) for k, (a, b) in model.p[r].items()}
        z = z + F.when(v == 1, ratio[1]).when(v == -1, ratio[-1]).otherwise(ratio[0])
    return 1 / (1 + F.exp(-z))


def verdict(f: Column, model: Votes, threshold: float = 0.5) -> Column:
    return ~base_failed(f) & (posterior(f, model) >= threshold)


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and quality (the posterior) for every document."""
    rows = written(with_features(docs.select("doc_id", "text")).select("doc_id", "_f"), f"{shared_dir(docs.sparkSession)}/features")  # counts, no texts
    model, f = fit(rows), F.col("_f")
    return rows.select("doc_id", *(f[k].alias(k) for k in FEATURES[:5]), base_failed(f).alias("base_failed"), verdict(f, model, threshold).alias("kept"), posterior(f, model).alias("quality"))


def keep(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that are kept, with the columns they came with. Texts are read twice rather than written once more."""
    model = fit(docs.select(features(F.col("text")).alias("_f")))
    return docs.where(let(features(F.col("text")), lambda f: verdict(f, model, threshold)))
