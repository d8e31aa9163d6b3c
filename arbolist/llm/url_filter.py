"""URL filter: prefix rules first, then logistic regression on hashed character n-grams of host and path.

The regression is trained on a small labelled URL table (URLS below, or any (host, path, label) rows a caller gives); it
needs no corpus pass. Scoring is one Arrow map over the page urls, without a shuffle.

Defined results: a null url, or one without "://", has an empty host and path; it fits no rule and the regression judges
the empty strings. A repeated row gives a repeated result; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, sigmoid

#: The rules of the production query: host, path prefix, verdict.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))

#: Labelled URLs to train on (fixed values): 1 is to be blocked.
URLS = (
    ("casino-win.example.com", "/en/1", 1), ("www.casino-win.example.net", "/slots/free-spins", 1), ("best-casino.example.org", "/bonus", 1), ("free-bets.example.com", "/de/12", 1),
    ("m.free-bets.example.org", "/promo/odds", 1), ("bet-now.example.net", "/live-betting", 1), ("spam-farm.example.org", "/en/728", 1), ("spam-farm.example.net", "/fr/9", 1),
    ("blog.spam-farm.example.com", "/offers/cheap-pills", 1), ("cheap-pills.example.com", "/buy/now", 1), ("poker-online.example.net", "/jackpot", 1), ("jackpot-slots.example.org", "/win/cash", 1),
    ("xxx-video.example.com", "/adult/cams", 1), ("adult-cams.example.net", "/xxx", 1), ("hot-singles.example.org", "/dating/adult", 1), ("quick-loan.example.com", "/payday/cash", 1),
    ("seo-links.example.net", "/buy-links/cheap", 1), ("win-prize.example.org", "/claim/free-prize", 1), ("malware-crack.example.com", "/warez/keygen", 1), ("torrent-crack.example.net", "/download/crack", 1),
    ("casino-win.example.org", "/fr/44.html", 1), ("free-bets.example.net", "/es/7/", 1), ("spam-farm.example.com", "/de/31", 1), ("replica-watch.example.org", "/cheap/replica", 1),
    ("example.com", "/en/", 0), ("www.example.net", "/de/10", 0), ("blog.news.example.org", "/fr/article/12", 0), ("docs.example.com", "/guide/start.html", 0),
    ("library.example.org", "/catalog/item/99", 0), ("m.weather.example.net", "/es/forecast/3", 0), ("university.example.org", "/courses/history", 0), ("www.museum.example.com", "/fr/visit", 0),
    ("blog.travel.example.net", "/de/station/8", 0), ("research.example.org", "/papers/1201.html", 0), ("wiki.example.com", "/page/Science", 0), ("recipes.example.net", "/en/bread/41", 0),
    ("tion.example.com", "/es/220", 0), ("blog.ther.example.org", "/en/14/", 0), ("www.thon.example.net", "/fr/901", 0), ("m.ther.example.com", "/de/77.html", 0),
    ("than.example.org", "/en/450", 0), ("blog.tion.example.net", "/es/533/", 0), ("www.health.example.org", "/en/advice/2", 0), ("city.example.net", "/services/water", 0),
    ("garden.example.com", "/plants/roses", 0), ("music.example.org", "/concerts/2020", 0), ("m.sport.example.net", "/en/football/8", 0), ("school.example.com", "/de/lessons/1", 0),
    ("", "", 0),
)


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: see the module's docstring."""
    after = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    # A-Z only: lower() would change letters beyond ASCII.
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict): the longest rule whose host is the host or a parent domain and whose path is a prefix; null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[:2])):  # the longest wraps the others, so it wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


class UrlModel:
    """Logistic regression on hashed character n-grams of host and path."""

    def __init__(self, rows: Iterable[tuple[str, str, int]], bits: int = 16, sizes: tuple[int, ...] = (3, 4, 5), l2: float = 1e-3, steps: int = 400, rate: float = 2.0):
        self.bits, self.sizes = bits, sizes
        rows = list(rows)
        feats, y = [self.features(h, p) for h, p, _ in rows], np.array([r[2] for r in rows], float)
        self.weights, self.bias = np.zeros(1 << bits), 0.0
        for _ in range(steps if rows else 0):
            p = sigmoid(np.array([self.weights[f].sum() * s for f, s in feats]) + self.bias)
            g = np.zeros_like(self.weights)
            for (f, s), d in zip(feats, (p - y) / len(rows), strict=True):
                np.add.at(g, f, d * s)
            self.weights -= rate * (g + l2 * self.weights)
            self.bias -= rate * float((p - y).mean())

    def features(self, host: str, path: str) -> tuple[np.ndarray, float]:
        """Slots of the distinct n-grams, and the factor that makes the vector one of unit length."""
        out = set()
        for tag, s in ((b"h", f"^{host}$"), (b"p", f"^{path}$")):
            b = s.encode("utf-8", "replace")
            out |= {zlib.crc32(tag + b[i : i + n]) & ((1 << self.bits) - 1) for n in self.sizes for i in range(len(b) - n + 1)}
        f = np.fromiter(sorted(out), np.int64, len(out))
        return f, 1 / max(1.0, len(f)) ** 0.5

    def score(self, host: str, path: str) -> float:
        f, s = self.features(host, path)
        return float(sigmoid(np.array([self.weights[f].sum() * s + self.bias]))[0])


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, urls: Iterable[tuple[str, str, int]] = URLS, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, and block_score: the regression's probability (for every page)."""
    model = UrlModel(urls)  # 2**16 weights: of fixed size
    host, path = parts(F.coalesce(F.col("url").cast("string"), F.lit("")))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))

    def scored(b: pa.RecordBatch) -> pa.RecordBatch:
        s = [model.score(h, p) for h, p in zip(b["host"].to_pylist(), b["path"].to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, "block_score"])

    kind = dict(split.dtypes)["page_id"]
    out = split.mapInArrow(by_batch(scored), f"page_id {kind}, host string, path string, block_score double")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("block_score") >= threshold, "block").otherwise("allow")).alias("verdict"), "block_score")
