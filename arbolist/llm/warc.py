"""WARC archives with per-file Zstandard dictionaries.

Each archive is a file: a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself a Zstandard frame, then one
Zstandard frame for each WARC record, so that a record can be read at its offset. The dictionary is built from pieces of the
same archive's records, spread evenly over all of it (of about TRAIN_BYTES together); an archive with too little to build
one from has none, and then begins with its first record.

A payload that was archived before is not stored again: of equal payloads of at least MIN_REVISIT bytes, the row with the
smallest page_id is a `response`, and the others are `revisit` records that refer to it.

Writers put archives below the folder that driver and executors share, under names that no other task attempt uses; only the
attempts that Spark commits are in the manifest, so a lost executor leaves no half archive behind in the result.

Defined results: null html is an empty payload; a null url is written as urn:page:<id>; rows that repeat the smallest
page_id with its payload are each a response; a null page_id counts as greater than any number (its revisits refer to the
smallest id there is; a group of null ids only has responses); an empty table writes no archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, written

DICT_MAGIC, ZSTD_MAGIC = 0x184D2A5D, 0xFD2FB528
MIN_REVISIT = 100
#: An archive is closed at this many bytes of records before compression.
ARCHIVE_BYTES = 24 << 20
TRAIN_BYTES, DICT_BYTES, PIECE = 1 << 20, 64 << 10, 4096
#: Bytes that a reader hands to the decompressor at once.
WINDOW = 1 << 14
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, records long, bytes long, dict_bytes long"


def record(page_id: int | None, url: str | None, kind: str, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record."""
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]|") if url else f"urn:page:{page_id}"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}|{kind}')}>", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {size}",
    ]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        block = head + b"\r\n"
    else:
        block = head + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record that record() made."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:20]!r}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if len(block) < int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    return fields, block.partition(b"\r\n\r\n")[2]


def build_dictionary(records: list[bytes]) -> bytes:
    """A Zstandard dictionary from pieces of the records, every so many of them; empty where there is too little to build one from."""
    every = max(1, sum(map(len, records)) // TRAIN_BYTES)
    pieces, k = [], 0
    for r in records:
        at = range(-k % every * PIECE, len(r), every * PIECE)
        pieces += [r[a : a + PIECE] for a in at]
        k += -(-len(r) // PIECE)
    total = sum(map(len, pieces))
    if len(pieces) < 16 or total < 16 << 10:
        return b""
    try:
        return zstd.train_dictionary(min(DICT_BYTES, total // 8), pieces, k=256, d=8).as_bytes()
    except zstd.ZstdError:  # nothing that repeats
        return b""


def archive_bytes(records: list[bytes], level: int = 3) -> tuple[bytes, int]:
    """(file, dictionary's bytes): the dictionary in a leading skippable frame, then a frame for each record."""
    raw = build_dictionary(records)
    out = io.BytesIO()
    if raw:
        packed = zstd.ZstdCompressor(level=level).compress(raw)
        out.write(struct.pack("<II", DICT_MAGIC, len(packed)) + packed)
    own = zstd.ZstdCompressionDict(raw) if raw else None
    if own:
        own.precompute_compress(level=level)
    c = zstd.ZstdCompressor(dict_data=own, write_checksum=True) if own else zstd.ZstdCompressor(level=level, write_checksum=True)
    for r in records:
        out.write(c.compress(r))
    return out.getvalue(), len(raw)


def read_archive(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) for each record of a file that archive_bytes() made."""
    at, own = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
        n = struct.unpack_from("<I", data, 4)[0]
        raw = data[8 : 8 + n]
        if struct.unpack_from("<I", raw)[0] == ZSTD_MAGIC:
            raw = zstd.ZstdDecompressor().decompress(raw)
        own, at = zstd.ZstdCompressionDict(raw), 8 + n
    d = zstd.ZstdDecompressor(dict_data=own) if own else zstd.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        o, rec, end = d.decompressobj(), b"", at
        while not o.eof:  # a window at a time: what a frame leaves over is copied
            if end >= len(data):
                raise ValueError(f"a frame at {at} is cut short")
            rec += o.decompress(view[end : end + WINDOW])
            end = min(end + WINDOW, len(data))
        yield at, rec
        at = end - len(o.unused_data)


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes, record_type, refers_to: what to write for each page."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    # Counted per digest before the shuffle, so that a payload of a third of all rows is a row for each task. What is dealt
    # out by digest are ids, of which the join splits what is skewed; payloads are dealt out by page and digest.
    light = rows.select("page_id", "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= MIN_REVISIT)
    many = (
        light.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
        .select(F.col("payload_digest").alias("d"), "first_id")
    )
    told = light.join(many, light["payload_digest"] == many["d"]).where(~F.col("page_id").eqNullSafe(F.col("first_id"))).select(F.col("page_id").alias("p"), "d", "first_id").distinct()
    again = F.col("first_id").isNotNull()
    return rows.join(told, rows["page_id"].eqNullSafe(told["p"]) & (rows["payload_digest"] == told["d"]), "left").select(
        "page_id", "url", F.when(again, F.lit("")).otherwise(F.col("html")).alias("html"), "payload_digest", "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("first_id").alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str, archive_size: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages as archives below folder (a URI that every machine can write to); returns the manifest."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        held, size = [], 0

        def close() -> pa.RecordBatch:
            data, dict_bytes = archive_bytes(held)
            path = f"{base}/{uuid.uuid4().hex}.warc.zst"
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(path, compression=None) as f:
                f.write(data)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(held)], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([dict_bytes], pa.int64())], names=["archive", "records", "bytes", "dict_bytes"])

        for b in batches:
            for r in zip(*(b[c].to_pylist() for c in ("page_id", "url", "record_type", "html", "payload_bytes", "payload_digest", "refers_to")), strict=True):
                held.append(record(r[0], r[1], r[2], r[3].encode("utf-8", "surrogatepass"), r[4], r[5], r[6]))
                size += len(held[-1])
                if size >= archive_size:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return with_revisits(pages).mapInArrow(run, MANIFEST)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long"


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each record of the manifest's archives. Digests and lengths of responses are taken anew and compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path, n in zip(b["archive"].to_pylist(), b["records"].to_pylist(), strict=True):
                rows = []
                with fs.open_input_stream(path, compression=None) as f:
                    data = f.read()
                for at, raw in read_archive(data):
                    h, payload = parse(raw)
                    size, digest, kind = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"]
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{path} at {at}: the payload is not what was archived")
                    to = h.get("WARC-Refers-To")
                    rows.append((int(h["X-Page-Id"]) if h["X-Page-Id"] else None, size, digest, kind, int(to[len("<urn:page:") : -1]) if to else None, path, at))
                if len(rows) != n:
                    raise ValueError(f"{path} has {len(rows)} records, not {n}")
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    # One archive is one unit of work: each goes to a task of its own as far as there are partitions.
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(parts, "archive").mapInArrow(run, READ)


def archive_and_read(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages as archives, then read every record back."""
    spark = pages.sparkSession
    folder = folder or shared_dir(spark)
    manifest = written(write_archives(pages, f"{folder}/warc"), f"{folder}/manifest")
    return read_archives(manifest, f"{folder}/warc")
