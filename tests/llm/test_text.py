"""WARC, SentencePiece, quality rules, personal data, decontamination: brute force, round trips and edge cases."""

import collections
import hashlib
import math
import re
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
import zstandard
from pyspark import cloudpickle
from pyspark.sql import functions as F

import corpus_pipeline
from arbolist.llm import common, decontaminate, entries, lang_id, pii, quality_net, quality_rules, sentencepiece_codec, signature_tree, textkit, toxicity, warc
from arbolist.llm.common import shared_dir, written

DATA = "/root/testdata/sf0.001"
NASTY = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "a b c d e a b c d e " * 4000), (6, "line\nline\n\nline\r\nline"), (6, "line\nline\n\nline\r\nline"), (None, "é ü 漢字 \U0001f600 a"), (8, "\u00a0 no-break \u2028 z " * 5)]


def docs_of(spark, rows):
    """Documents in a file, as tables are: Spark runs plans over local rows on the driver, without compiling them."""
    rows = spark.createDataFrame([(i, t, "en", 3, "clash", [1]) for i, t in rows], "doc_id long, text string, lang string, n_words int, spans string, kept array<int>")
    return written(rows, f"{shared_dir(spark)}/docs")


# WARC


def test_archive_round_trip():
    rng = np.random.default_rng(0)
    payloads = [b"", b"x", *(" ".join(rng.choice(["<p>", "the", "page", "of", "html", "ü"], n)).encode() for n in rng.integers(1, 3000, 300))]
    records = [warc.record(i, f"http://h/{i} é\r\n", "response", p, len(p), hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads)]
    data, size = warc.archive_bytes(records)
    assert size > 0 and struct.unpack_from("<I", data)[0] == warc.DICT_MAGIC
    out = list(warc.read_archive(data))
    assert [r for _, r in out] == records and [warc.parse(r)[1] for _, r in out] == payloads
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + struct.unpack_from("<I", data, 4)[0]]))
    at = out[100][0]  # a record can be read by itself, at its offset
    assert zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(data[at:]) == records[100]
    with pytest.raises(ValueError, match="cut short"):
        list(warc.read_archive(data[:-5]))
    few, none = warc.archive_bytes(records[:2])
    assert none == 0 and [r for _, r in warc.read_archive(few)] == records[:2]


def test_pages_and_revisits(spark):
    big, other = "b" * 100, "c" * 99
    rows = [(5, "http://a/", big), (3, None, big), (9, "u", big), (3, None, big), (None, "n", big), (1, "x", other), (2, "x", other), (4, None, None), (6, "", ""), (7, "y", "é" * 50), (8, "y", "é" * 50)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to int")
    folder = shared_dir(spark)
    manifest = written(warc.write_archives(pages, f"{folder}/w", archive_size=400), f"{folder}/m")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_archives(manifest, f"{folder}/w").collect()), key=str)
    want = sorted([(5, 100, "revisit", 3), (3, 100, "response", None), (9, 100, "revisit", 3), (3, 100, "response", None), (None, 100, "revisit", 3), (1, 99, "response", None), (2, 99, "response", None), (4, 0, "response", None), (6, 0, "response", None), (7, 100, "response", None), (8, 100, "revisit", 7)], key=str)
    assert got == want
    fs, base = pafs.FileSystem.from_uri(f"{folder}/w")
    assert manifest.count() == len(fs.get_file_info(pafs.FileSelector(base))) and manifest.agg(F.sum("records")).first()[0] == len(rows)
    assert warc.archive_and_read(pages.limit(0)).count() == 0


# SentencePiece


def unigram_model(pieces, unk=0, bytes_too=True):
    """The bytes of a small unigram model."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def put(number, body):
        return varint(number << 3 | 2) + varint(len(body)) + body

    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + ([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if bytes_too else []) + [(p, s, 1) for p, s in pieces]
    out = b"".join(put(1, put(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(k)) for p, s, k in rows)
    trainer = varint(3 << 3) + varint(1) + varint(35 << 3) + varint(int(bytes_too)) + varint(40 << 3) + varint(unk)
    normal = put(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(0) + varint(5 << 3) + varint(1)
    return out + put(2, trainer) + put(3, normal)


def test_unigram_parity():
    data = unigram_model([("▁", -2.0), ("▁the", -1.5), ("he", -2.5), ("t", -4.0), ("h", -4.1), ("e", -4.2), ("▁cat", -3.0), ("c", -5.0), ("a", -5.1), ("at", -3.3), ("s", -4.4), ("▁▁", -3.1)])
    texts = ["the cat", "  the  cats", "chat é", "", " ", "thethe cat s", "a\nb", "<s> the </s><unk>", "x<0x41> <0x42>", "  <0x41>the", "\U0010ffff\U0010fffe1\U0010ffff"]
    sentencepiece_codec.verify(data, texts)
    codec = sentencepiece_codec.Codec.of(data)
    assert codec.model.kind == 1 and codec.decode(codec.encode(texts)) == texts


def test_bpe_parity_and_round_trip(spark):
    with open(sentencepiece_codec.MODEL, "rb") as f:
        data = f.read()
    own = sentencepiece_codec.library(data)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1 - k, t) for k, t in enumerate([None, *sentencepiece_codec.PROBES, "▁ marker", "=-" * 3000 + " " * 500 + "é" * 4000])], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    out = written(sentencepiece_codec.encode(docs), f"{shared_dir(spark)}/t")
    for r in out.collect():
        assert list(r["token_ids"]) == own.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["token_ids"])
        assert r["lossless"] == ("▁" not in texts[r["doc_id"]])
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(out).collect()}
    assert all(back[i] == t for i, t in texts.items() if "▁" not in t)
    assert sentencepiece_codec.encode(docs.limit(0)).count() == 0


def test_words_are_forgotten(monkeypatch):
    with open(sentencepiece_codec.MODEL, "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    monkeypatch.setattr(sentencepiece_codec, "KEPT", 5)
    texts = ["one two three four five six seven", "eight nine", "one " + "long" * 40, "one two"]
    want = [x.ids for x in codec.first.encode_batch_fast(texts, add_special_tokens=False)]
    assert [codec.encode([t])[0] for t in texts] == want and len(codec.place) <= 8


def test_unigram_model_on_a_table(spark, tmp_path):
    """The unigram part over whole documents, against the sentencepiece library, with repeated rows."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(60)
    seen = collections.Counter(w[:n] for r in docs.collect() for w in (r["text"] or "").split() for n in (1, 2, 3, 4, 6))
    rng = np.random.default_rng(2)  # scores without ties, which the libraries may break in different ways
    pieces = {("▁" + w if k % 2 else w): -float(rng.uniform(2, 12)) for k, (w, _) in enumerate(seen.most_common(600)) if "▁" not in w}
    path = tmp_path / "unigram.model"
    path.write_bytes(unigram_model([("▁", -3.0), *((p, s) for p, s in pieces.items() if len(p.encode()) > 1 or p.isalnum())]))
    own = sentencepiece_codec.library(path.read_bytes())
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = sentencepiece_codec.encode(docs.union(docs), str(path)).collect()
    assert len(got) == 2 * len(texts) and all(list(r["token_ids"]) == own.encode(texts[r["doc_id"]]) for r in got)


def test_no_model_is_an_error():
    with pytest.raises(ValueError):
        sentencepiece_codec.parse_model(b"\x0b\xff\xff\xff")


# Quality rules


def base_of(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_base_against_a_loop(spark):
    rows = NASTY + [(r["doc_id"] + 100, r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = quality_rules.judge(docs_of(spark, rows)).collect()
    ours = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got)
    assert ours == collections.Counter((i, *(b := base_of(t)), b[0] < 10 or 100 * b[4] > 20 * b[0]) for i, t in rows)
    assert all(not (r["base_failed"] and r["kept"]) and 0 <= r["quality"] <= 1 for r in got)
    kept = collections.Counter(r["doc_id"] for r in got if r["kept"])
    stays = quality_rules.keep(docs_of(spark, rows))
    assert stays.columns == ["doc_id", "text", "lang", "n_words", "spans", "kept"] and collections.Counter(r["doc_id"] for r in stays.collect()) == kept
    assert quality_rules.judge(docs_of(spark, rows).limit(0)).count() == 0


def test_estimates_against_the_likelihood():
    rng = np.random.default_rng(0)
    right = {"a": 0.9, "b": 0.85, "c": 0.8, "d": 0.75, "e": 0.9, "f": 0.8, "g": 0.85}
    names = list(right)
    counts = collections.Counter()
    for _ in range(20000):
        good = rng.random() < 0.8
        counts[tuple((1 if good else -1) * (1 if rng.random() < right[r] else -1) if rng.random() < 0.7 else 0 for r in names)] += 1
    model = quality_rules.estimate([(dict(zip(names, p, strict=True)), n) for p, n in sorted(counts.items())], names, weight=1e-4)
    assert abs(model.prior - 0.8) < 0.05
    for r in names:
        assert abs(model.p[r][1][0] / (model.p[r][1][0] + model.p[r][-1][0]) - right[r]) < 0.05
    z = quality_rules.log_odds(model, dict.fromkeys(names, 1))
    assert 1 / (1 + math.exp(-z)) > 0.95


def test_quality_is_native(spark):
    plan = quality_rules.with_features(docs_of(spark, NASTY))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# Personal data

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def spans_of(text):
    out = []
    for kind, p in KINDS:
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


PII = ["mail a.b+c@ex-am.ple.org, x@y.z+w@q.r @@ a@b a@b.c.", "1.2.3.4 256.1.1.1 001.02.3.255 1.2.3.4.5.6.7.8 99999999999.1.1.1 1..2", "4111 1111 1111 1111 4111-1111-1111-1112 5500005555555559 1 2 3", "+1 (555) 123-4567 +12 ++49 30 1234567890 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6", "é漢 a@b.co \U0001f600 +44 20 7946 0958", "1" * 3000, "a" * 3000 + "@b", "a@b" + ".c" * 5000, "1-" * 3000, "+1" * 3000]


def test_entities_against_regex(spark):
    rows = NASTY + [(100 + k, t) for k, t in enumerate(PII)] + [(r["doc_id"] + 1000, r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = pii.find(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {(i, t): spans_of(t) for i, t in rows}
    by_id = {i: want[i, t] for i, t in rows}
    for r in got:
        s = by_id[r["doc_id"]]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(x[0] == k for x in s) for k, _ in KINDS]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and (r["spans"] == text or r["spans"].startswith(text))
    assert pii.find(docs_of(spark, rows).limit(0)).count() == 0


def secret_rows():
    """Entities with a word that stands beside them alone, and one that stands everywhere."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):
        noise = " ".join(str(x) for x in rng.choice([f"word{chr(97 + a)}{chr(97 + b)}" for a in range(9) for b in range(9)], 12))
        rows.append((k, f"{noise} please contact zebrafish{'':s} at zoe@corp.example regarding common {noise}" if k % 10 == 0 else f"{noise} common contact please regarding {noise}"))
    return rows


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_disclosing_terms_against_counts(spark, monkeypatch, few):
    monkeypatch.setattr(pii, "FEW", few)
    got, want = disclosed(spark, secret_rows() * 2)
    assert got == want and "zebrafish" in got[0] and not any("common" in x for x in got.values())


ODD = "doc_id long, text string, `a.b` string, `m` map<string,int>, _t string, _e int, t string, e string, s string, h string, row string, none string, terms string, name string, `check` string, k0 string, n_tokens string, n_chars int"


def odd_docs(spark, rows):
    """Documents with columns of all the names that operators use themselves, a dotted one and a map."""
    made = [(i, t, f"dot{k}", {"x": k, "y": 2}, f"t{k}", k, "1", "2", "3", "4", "5", "6", "7", f"name{k}", "c", "k", "n", len(t or "")) for k, (i, t) in enumerate(rows)]
    return written(spark.createDataFrame(made, ODD), f"{shared_dir(spark)}/odd")


def test_stages_keep_columns_of_any_name(spark):
    rows = [*secret_rows(), (900, "card 4111 1111 1111 1111, ip 10.0.0.1 and some more words to be kept here"), (901, None), (901, None), (902, ""), (903, "clean text of ten words that is kept as it is here")]
    docs = odd_docs(spark, rows)
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    plain = lambda df, cols: sorted((str([r[c] for c in cols]) for r in df.collect()))
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.schema.simpleString() == docs.schema.simpleString() and plain(clean, others) == plain(docs, others)
    assert {r["text"] for r in clean.collect() if r["doc_id"] in (900, 901, 902)} == {"card [CARD], ip [IP] and some more words to be kept here", None, ""}
    one = signature_tree.keep_one(docs.union(docs))
    assert one.columns == docs.columns and set(plain(one, docs.columns)) <= set(plain(docs, docs.columns)) and one.where("doc_id = 901").count() >= 1 and one.where("doc_id = 903").count() == 1
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and set(plain(kept, docs.columns)) <= set(plain(docs, docs.columns))
    left = decontaminate.drop_contaminated(docs, spark.createDataFrame([("x1", "clean text of ten words that is kept")], "item_id string, text string"))
    assert left.columns == docs.columns and plain(left, docs.columns) == plain(docs.where("doc_id <> 903"), docs.columns)
    carried = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = sentencepiece_codec.encode(docs, carry=tuple(carried))
    own = [c for c in carried if c not in sentencepiece_codec.MADE]
    assert out.columns == ["doc_id", *own, "n_tokens", "token_ids", "lossless"] and plain(out, ["doc_id", *own]) == plain(docs, ["doc_id", *own])
    assert corpus_pipeline.tokens(spark, docs.limit(0), DATA).count() == 0 and sorted(r["n_tokens"] for r in corpus_pipeline.tokens(spark, docs, DATA).collect() if r["doc_id"] in (901, 902)) == [0, 0, 0]


def test_ids_may_be_strings(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text", "lang")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    held, n = F.lit(False), docs.count()
    table = quality_net.context_table(docs)
    assert toxicity.tag(docs, toxicity.train(docs, labels, held), held).count() == quality_net.classify(docs, quality_net.train(docs, labels, held, table), table, held).count() == n
    assert lang_id.identify(docs, lang_id.train(docs, held), held).count() == signature_tree.join(docs).count() == n
    items = spark.createDataFrame([("q1", docs.first()["text"][:200])], "item_id string, text string")
    assert {r["item_id"] for r in decontaminate.search(docs, items).collect()} <= {"q1"}


def test_sanitised_texts(spark):
    rows = [*secret_rows(), (900, "card 4111 1111 1111 1111, ip 10.0.0.1"), (901, None), (901, None), (902, "clean text")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    assert got[900]["text"] == "card [CARD], ip [IP]" and got[900]["n_chars"] == 20 and got[901]["text"] is None and got[902]["text"] == "clean text"
    assert "[EMAIL]" in got[0]["text"] and "zebrafish" not in got[0]["text"] and got[1]["text"] == dict(rows)[1]
    assert pii.sanitise(docs).columns == docs.columns and pii.sanitise(docs).count() == len(rows)


# Decontamination


def test_lcs_against_the_table():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(0, 6, rng.integers(0, 40))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.lcs(a.astype(np.uint64), b.tolist()) == t[-1, -1]


def test_space_against_the_exact_decomposition():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(400, 20)) @ rng.normal(size=(20, 1 << 8))
    x = rng.normal(size=(1 << 8, 60))
    s = decontaminate.space(np.ones(1 << 8, np.float32), x, a.T @ (a @ x))
    y = a @ s.table[:, :20]
    assert np.allclose(y.T @ y, np.eye(20), atol=1e-2)  # the singular directions, each of variance one


def test_window_blocks_against_sums(monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 64)
    rng = np.random.default_rng(3)
    space = decontaminate.Space(np.ones(1 << decontaminate.BITS, np.float32), rng.normal(size=(1 << decontaminate.BITS, 5)).astype(np.float32))
    s = decontaminate.Searcher(space, [decontaminate.item(1, " ".join(f"w{k}" for k in range(30)))])
    bounds = np.array([0, 0, 7, 8, 390])
    h = textkit.mix(np.arange(390, dtype=np.uint64))
    h[20:24] = h[20]  # a word that repeats the one before has no vector
    w = textkit.Words(np.zeros(390), np.zeros(390), h, bounds)
    vec = space.table[decontaminate.slot(h)]
    vec[21:24] = 0
    seen = []
    for docs, begin, n in decontaminate.pieces_of(bounds):
        sums, first = s.blocks(w, begin, n, 8, 16)
        for k, (d, a, m) in enumerate(zip(docs, begin, n, strict=True)):
            own = vec[a : a + m].copy()
            own[0] = space.table[decontaminate.slot(h[a : a + 1])[0]]
            for j in range(int(first[k + 1] - first[k])):
                assert np.allclose(sums[first[k] + j], own[8 * j : 8 * j + 8].sum(0), atol=1e-4)
            assert first[k + 1] - first[k] >= 3 + -(-m // 8)
            seen.append((int(d), int(a), int(m)))
    assert [x for x in seen if x[0] < 3] == [(1, 0, 7), (2, 7, 1)]
    assert [x for x in seen if x[0] == 3] == [(3, 8 + a, min(64 + 128, 382 - a)) for a in range(0, 382, 64)]


def test_words_are_folded_alike():
    pairs = [("ÉTÉ Straße ＡＢＣ ΟΔΟΣ", "été STRASSE abc οδος"), ("ﬁne Å", "fine å"), ("e\u0301te", "éte")]
    for a, b in pairs:
        assert (decontaminate.hashes(a) == decontaminate.hashes(b)).all()
    raw, off = decontaminate.folded(pa.array([b"\xff\xe9 x", None, b"\xc3\x89\xc3\x97\xc3\x9f", b"\xc3"]).view(pa.string()))
    assert [raw[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)] == ["\ufffd\ufffd x".encode(), b"", "é×ss".encode(), b"\xc3"]


def test_benchmark_passages_are_found(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    texts = {r["item_id"]: r["text"] for r in items.collect()}
    filler = [r["text"] for r in docs.orderBy("doc_id").limit(12).collect()]
    planted, rng = [], np.random.default_rng(4)
    for k, (i, t) in enumerate(sorted(texts.items())):
        words = t.split()
        if k % 2:  # a paraphrase: one word in eight is another
            words = [w if rng.random() > 0.125 else "anotherword" for w in words]
        planted.append((10_000 + i, filler[k % 12][:3000] + "\n" + " ".join(words).upper() + "\n" + filler[(k + 1) % 12][:2000]))
    rows = docs.unionByName(spark.createDataFrame([*planted, (None, None), (20_000, ""), (20_001, "x")], "doc_id long, text string"))
    more = items.unionByName(spark.createDataFrame([(500, None), (501, ""), (502, "...")], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.search(rows, more).collect()}
    want = {(10_000 + i, i) for i in texts}
    assert len(want & got) >= 0.95 * len(want)
    exact = {(r["doc_id"], i) for r in docs.collect() for i, t in texts.items() if t in r["text"]}
    assert len(exact & got) >= 0.9 * len(exact)
    for d, i in got - want - exact:  # nothing else but what holds most of an item's words in order
        if d is not None and d < 10_000:
            text = next(r["text"] for r in docs.where(F.col("doc_id") == d).collect())
            h = decontaminate.hashes(text).tolist()
            assert decontaminate.lcs(decontaminate.hashes(texts[i]), h) >= 0.6 * len(decontaminate.hashes(texts[i]))
    left = decontaminate.drop_contaminated(rows, more)
    assert left.columns == rows.columns and left.count() == rows.count() - len({d for d, _ in got})
    assert decontaminate.search(rows, more.limit(0)).count() == 0 and decontaminate.search(rows.limit(0), more).count() == 0
    assert entries.ORACLE.keys() <= entries.queries().keys()


def window_scores(h, item):
    """The greatest share of the item's words that any window of twice its length holds in order."""
    n = len(item.words)
    return max((decontaminate.lcs(item.words, h[a : a + 2 * n]) / n for a in range(0, max(1, len(h)), max(1, n // 4)) if len(item.known.intersection(h[a : a + 2 * n])) >= 0.5 * len(item.known)), default=0.0)


def test_search_against_all_windows(spark):
    """What a loop over all windows finds by LCS, with long items too: nothing else is found, and at least nine in ten of these are."""
    rng = np.random.default_rng(12)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    source = [t for _, t in docs if t and len(t.split()) > 1200][:6]
    items |= {900 + k: " ".join(t.split()[100 : 100 + n]) for k, (t, n) in enumerate(zip(source, (170, 250, 400, 600, 800, 1000), strict=False))}
    for k, i in enumerate(sorted(items)):
        words = [w if rng.random() > 0.15 else f"other{rng.integers(99)}" for w in items[i].split()]
        docs.append((50_000 + i, " ".join([*docs[k][1].split()[:150], *words, *docs[k + 50][1].split()[:200]])))
    rows = spark.createDataFrame([*docs, *docs[-3:]], "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["lcs"] for r in decontaminate.search(rows, bench.union(bench.limit(2))).collect()}
    want = {}
    made = [decontaminate.item(i, t) for i, t in items.items()]
    for d, t in docs:
        h = decontaminate.hashes(t or "").tolist()
        for x in made:
            if len(h) and (s := window_scores(h, x)) >= decontaminate.LCS and (not x.told or decontaminate.lcs(x.answer, h) >= decontaminate.ANSWER * len(x.answer)):
                want[d, x.item_id] = s
    hit = [k for k in want if k in got]
    long = [k for k in want if k[1] >= 900 and k[0] >= 50_000]
    assert len(hit) >= 0.9 * len(want) and all(k in got for k in long) and len(long) >= 3
    by_id = dict(docs)
    for d, i in set(got) - set(want):  # the loop's windows lie elsewhere: the words are there in order
        x = next(x for x in made if x.item_id == i)
        assert decontaminate.lcs(x.words, decontaminate.hashes(by_id[d]).tolist()) >= decontaminate.LCS * len(x.words)


def disclosed(spark, rows):
    """For each document the terms that pii.find() gives, and the same by brute force."""
    texts = dict(rows)
    spans = {r["doc_id"]: r["spans"] for r in pii.find(docs_of(spark, rows)).collect()}
    got = {i: {texts[i][int(x.split(":")[1]) : int(x.split(":")[2])].lower() for x in s.split(",") if x.startswith("term")} for i, s in spans.items()}
    with_keys, all_words = {}, collections.Counter()
    for i, t in rows:
        found, rest = spans_of(t), t
        for _, a, b in found:
            rest = rest[:a] + " " * (b - a) + rest[b:]
        terms = {x.lower() for x in re.findall(r"[^\W_]+", rest) if len(x) > 3 or (len(x) > 1 and (x[0].isupper() or re.search(r"\d", x) or not x.lower() != x.upper()))}
        with_keys[i] = ({k for k, _, _ in found} | {(k, re.sub(r"[^A-Za-z0-9@.]", "", t[a:b]).lower()) for k, a, b in found}, terms)
        all_words.update({x.lower() for x in re.findall(r"[^\W_]+", t)})
    n_e, both, seen = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for i, t in rows:
        n_e.update(with_keys[i][0])
        for pair in ((e, w) for e in with_keys[i][0] for w in with_keys[i][1]):
            both[pair] += 1
            seen[pair].add(t)
    n = len(rows)
    told = {(e, w) for (e, w), c in both.items() if n_e[e] < n and math.log(c / all_words[w] * (k := len(seen[e, w])) / (k + pii.PRIOR) * n / n_e[e]) / math.log(n / n_e[e]) >= pii.THRESHOLD}
    return got, {i: {w for w in with_keys[i][1] if any((e, w) in told for e in with_keys[i][0])} for i, _ in rows}


def test_rare_entities_disclose(spark):
    rng = np.random.default_rng(6)
    vocab = [f"{a}{b}{c}ing" for a in "bcdfgklm" for b in "aeiou" for c in "nrst"]
    rows = [(k, " ".join(str(x) for x in rng.choice(vocab, 30))) for k in range(1500)]
    rows[:40] = [(k, f"{rows[k][1]} Telefon +49 30 {5550000 + k} bitte") for k in range(40)]  # each number once, one word for all
    rows[40] = (40, rows[40][1] + " quillfeather q@one.example")  # one address of one text
    got, want = disclosed(spark, rows)
    assert got == want and all("telefon" in got[k] for k in range(40)) and "quillfeather" in got[40] and not any(got[k] for k in range(41, 1500))


def test_terms_far_off_and_short(spark):
    rows = [(k, f"{'filler words here ' * (k + 5)} Kim of X7 in {'more filler ' * (k + 9)} 王明 the end. Write to us: Jo's Shop, j@shop.example, Kim") for k in range(8)]
    rows += [(100 + k, f"filler words more here in of the end {k % 7} write to us shop an li") for k in range(120)]
    rows += [(300 + k, f"solitary unseen w@copied.example {'unseen ' * 20}") for k in range(9)]  # copies of one text
    got, want = disclosed(spark, rows)
    assert got == want and {"kim", "x7", "王明", "jo"} <= got[0] and not {"of", "in", "filler", "shop"} & got[0]
    assert got[300] == set()


def test_items_of_all_lengths_are_found():
    rng = np.random.default_rng(8)
    space = decontaminate.Space(np.ones(1 << decontaminate.BITS, np.float32), rng.normal(size=(1 << decontaminate.BITS, 100)).astype(np.float32))
    vocab = [f"v{k}" for k in range(3000)]
    text = lambda n: " ".join(str(x) for x in rng.choice(vocab, n))
    exact = {n: f"own{n} {text(n - 1)}" if n > 1 else "own1" for n in (1, 2, 3, 4, 8, 16, 100, 200, 1000, 3000)}
    changed = {n: " ".join(w if k % 8 else "other" for k, w in enumerate(t.split())) for n, t in exact.items() if n >= 100}
    s = decontaminate.Searcher(space, [decontaminate.item(n, t) for n, t in exact.items()])
    for n, t in [*exact.items(), *changed.items()]:
        w = next(decontaminate.runs([pa.record_batch({"text": [f"{text(700)} {t} {text(500)}", text(900)]})], most=1 << 30))[3]
        got = s.run(w)
        assert n in got[0] and got[0][n][1] >= (1.0 if t == exact[n] else 0.8) and n not in got[1]


def test_copies_without_the_last_sentence():
    rng = np.random.default_rng(9)
    space = decontaminate.Space(np.ones(1 << decontaminate.BITS, np.float32), rng.normal(size=(1 << decontaminate.BITS, 100)).astype(np.float32))
    body, last = " ".join(f"b{k}" for k in range(30)), " ".join(f"l{k}" for k in range(8))
    s = decontaminate.Searcher(space, [decontaminate.item(1, f"{body}. {last}."), decontaminate.item(2, f"{body} Answer: {last}")])
    w = next(decontaminate.runs([pa.record_batch({"text": [f"before it {body} after it", f"{body} answer {last}"]})]))[3]
    got = s.run(w)
    assert set(got[0]) == {1} and got[0][1][2] < decontaminate.ANSWER and set(got[1]) == {1, 2}


def test_sample_of_distinct_texts(spark):
    rows = [(k, f"text number {k}") for k in range(2000)] + [(5000 + k, f"text shared {k % 3}") for k in range(3000)]
    got = [r["text"] for r in decontaminate.sampled(docs_of(spark, rows), 500).collect()]
    assert len(got) == len(set(got)) and 350 < len(got) < 650
    assert decontaminate.sampled(docs_of(spark, rows), 10_000).count() == 2003


def test_space_is_fitted_on_all_texts(spark, monkeypatch):
    """A'Ax against a loop over the passages of all distinct texts: more texts than any sample had, a long one, copies and nulls."""
    long = " ".join(f"far{k % 700}" for k in range(3000))
    rows = [(k, f"text number {k} of w{k % 97} w{k % 89} w{k % 83}") for k in range(9000)] + [(20_000 + k, "one text of many copies") for k in range(3000)] + [(30_000, long), (30_001, None), (30_002, "")]
    seen = {}
    monkeypatch.setattr(decontaminate, "space", lambda idf, x, z: seen.update(idf=idf, x=x, z=z))
    decontaminate.fit(docs_of(spark, rows))
    want = np.zeros_like(seen["z"])
    idf = seen["idf"].astype(np.float64)
    for text in {t for _, t in rows if t}:
        h = decontaminate.hashes(text)
        s = decontaminate.slot(h[decontaminate.first_of_runs(h)])
        for a in range(0, len(s), decontaminate.FIT):
            own = s[a : a + decontaminate.FIT]
            y = (seen["x"][own] * idf[own, None]).sum(0) / max((idf[own] ** 2).sum(), 1e-6)
            np.add.at(want, own, y * idf[own, None])
    assert np.abs(seen["z"] - want).max() < 1e-4 * np.abs(want).max()


def test_stage_takes_no_sample(spark, monkeypatch):
    """What drop_contaminated() fits its space on is not sampled."""
    monkeypatch.setattr(decontaminate, "sampled", lambda *a: pytest.fail("sampled"))
    item = " ".join(f"told{k}" for k in range(20))
    docs = docs_of(spark, [(1, f"before it {item} after it"), (2, "some other words of no item"), (3, None)])
    left = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id int, text string"))
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3]


def test_slots_and_sums_against_loops(monkeypatch):
    """What the fit counts and adds up; a passage's words are added in one step, and items' starts are found by their first bits and then whole."""
    rng = np.random.default_rng(4)
    size = np.array([48, 1, 17, 48, 30, 48])
    s, p = rng.integers(0, 40, size.sum()), np.repeat(np.arange(6), size)
    s[:3] = (1 << decontaminate.BITS) - 1
    got = decontaminate.holders(s, p)
    assert len(got) == 1 << decontaminate.BITS and all(got[k] == len(set(p[s == k].tolist())) for k in set(s.tolist())) and got.sum() == len(set(zip(s.tolist(), p.tolist(), strict=True)))

    steps, real = [], decontaminate.row_sums
    monkeypatch.setattr(decontaminate, "row_sums", lambda table, at: steps.append(at.shape) or real(table, at))
    table = np.vstack([rng.normal(size=(40, 3)), np.zeros((1, 3))])
    want = np.stack([table[s[p == k] % 40].sum(0) for k in range(6)])
    assert np.allclose(decontaminate.segment_sums(table, s % 40, size, decontaminate.FIT), want) and steps == [(decontaminate.FIT, 6)]
    assert np.allclose(decontaminate.segment_sums(table, s % 40, size, 4), want)

    space = decontaminate.Space(np.ones(1 << decontaminate.BITS, np.float32), rng.normal(size=(1 << decontaminate.BITS, decontaminate.RANK)).astype(np.float32))
    items = [decontaminate.item(k, " ".join(f"i{k}w{j}" for j in range(1 + k % 11))) for k in range(300)]
    searcher = decontaminate.Searcher(space, items)
    texts = [" ".join(f"i{k}w{j}" for j in range(1 + k % 11)) + " " + " ".join(f"x{j}" for j in rng.integers(0, 10**6, 50)) for k in range(300)]
    w = next(decontaminate.runs([pa.record_batch({"text": texts})], most=1 << 30))[3]
    found = [{} for _ in texts]
    searcher.copies(w, found)
    assert found == [{k: (1.0, 1.0, 1.0)} for k in range(300)]


def test_worker_memory(monkeypatch):
    """Passages in fewer than 128 MB beside their words, and a worker's memory given back, with the codec of an operator before."""
    rng = np.random.default_rng(3)
    n = decontaminate.HELD
    s, p = (rng.zipf(1.3, n) % (1 << decontaminate.BITS)).astype(np.int64), np.arange(n) // decontaminate.FIT
    idf, rows = np.ones(1 << decontaminate.BITS, np.float32), np.zeros(((1 << decontaminate.BITS) + 1, decontaminate.RANK + decontaminate.OVER), np.float32)
    tracemalloc.start()
    decontaminate.shares(s, p, idf, rows)
    assert tracemalloc.get_traced_memory()[1] < 128 << 20
    tracemalloc.stop()

    assert any(sentencepiece_codec.Codec.made is x for x in common.KEPT_IN_WORKER)
    made = {1: bytes(1 << 20)}
    monkeypatch.setattr(common, "KEPT_IN_WORKER", [made])
    assert len(cloudpickle.dumps(common.lean(iter))) < 10_000  # what the driver keeps is not sent to each task
    monkeypatch.setattr(common, "_least", 0)
    before = []

    def run(batches):
        held = [bytes(1000) for _ in range(200_000)]  # 200 MB
        last = bytes(1000)  # above them, so that nothing is given back by itself
        before.append(common.resident())
        del held
        yield from batches
        before.append(len(last))

    batch = pa.record_batch({"x": [1]})
    assert list(common.lean(run)(iter([batch]))) == [batch] and not made and common.resident() < before[0] - (100 << 20)


def test_words_by_place():
    """Hashes are those of the definition, for short and long words and bytes beyond ASCII, in less memory than 24 bytes a byte of text."""
    rng = np.random.default_rng(4)
    texts = ["", "a", "Ab cD", "é" * 9 + " x", "y" * 23 + " " + "z" * 24 + " " + "w" * 25 + " " + "v" * 5000, "tail", "", "next"]
    raw, off = textkit.text_bytes(pa.array(texts))
    w = textkit.words(raw, off, textkit.ALNUM)
    place = textkit.place_table(5000)

    def plain(t: bytes) -> int:
        total = sum(int(textkit._BYTE[textkit.LOWER[c]]) * int(place[i]) for i, c in enumerate(t)) + 0x9E3779B97F4A7C15 * len(t)
        return int(textkit.mix(np.array([total % (1 << 64)], np.uint64))[0])

    want = [[plain(x) for x in re.findall(rb"[0-9A-Za-z\x80-\xff]+", t.encode())] for t in texts]
    assert [w.hash[a:b].tolist() for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)] == want

    raw = rng.choice(np.frombuffer(b"abcdefgh  ", np.uint8), 1 << 20)
    tracemalloc.start()
    textkit.words(raw, np.array([0, len(raw)]), textkit.ALNUM)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 * len(raw), most / len(raw)
