"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with whole records of together about ``frame_bytes``, then a
skippable frame with the seek table of the public seekable format: compressed and decompressed size of every frame
(u32 each), then the number of frames (u32), a descriptor byte and the magic number. A record is found by its bundle,
frame and offset within the decompressed frame, so reading one record decompresses one frame.

Records with equal payloads of at least ``least`` bytes are stored once: the one with the largest page_id is a
response, the others are revisits that name it (WARC-Refers-To) and keep the HTTP header with the full length, and
the digest of the full payload. Equal payloads are found by digest with a pre-aggregated join, which Spark can split
where one payload has very many copies; each task of the join writes bundles under names of its own attempt, and the
index names only those of attempts that counted.

Null html: an empty payload, a response. Null url: an empty target. Null page_id: a response or revisit like others,
last among equals. Rows that repeat page_id and payload: responses all. Empty table: no bundles. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import file_system, folder, settled

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, record_id string, bundle string, frame int, place long, size long"
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 28
LEAST = 1000


class BundleWriter:
    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.out, self.frame_bytes, self.press = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.table: list[tuple[int, int]] = []
        self.waiting, self.size, self.written = [], 0, 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the frame) of the record."""
        if self.size and self.size + len(record) > self.frame_bytes:
            self._flush()
        at = len(self.table), self.size
        self.waiting.append(record)
        self.size += len(record)
        return at

    def _flush(self) -> None:
        raw = b"".join(self.waiting)
        packed = self.press.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw)))
        self.written += len(packed)
        self.waiting, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)


class BundleReader:
    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - 9)
        n, descriptor, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        entry = 12 if descriptor & 0x80 else 8
        file.seek(size - 9 - n * entry)
        raw, place = file.read(n * entry), 0
        self.frames = []
        for k in range(n):
            packed, plain = struct.unpack_from("<II", raw, k * entry)
            self.frames.append((place, packed, plain))
            place += packed

    def frame(self, k: int) -> bytes:
        place, packed, plain = self.frames[k]
        self.file.seek(place)
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=plain)


def header(lines: list[tuple[str, str]], first: str) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in lines), "", ""]).encode()


def target(url: str | None) -> str:
    """A URL that fits one header line."""
    return "".join(c if c > " " and c != "\x7f" else "%{:02X}".format(ord(c)) for c in url or "")


def record_id(page_id: int | None, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{number}')}>"


def record(rid: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, day: str) -> bytes:
    """One WARC/1.1 record; ``digest`` is the payload's SHA-1 in hex."""
    http = header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http if revisit else http + payload
    lines = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", rid), ("WARC-Date", day),
             ("WARC-Target-URI", target(url)), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if page_id is not None:
        lines.append(("X-Page-ID", str(page_id)))
    if revisit:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        if refers_to is not None:
            lines += [("WARC-Refers-To", record_id(refers_to, 0)), ("X-Refers-To-Page", str(refers_to))]
    lines += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return header(lines, "WARC/1.1") + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record header, HTTP header, payload) of a record."""
    def fields(head: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])

    head, _, rest = raw.partition(b"\r\n\r\n")
    own = fields(head)
    http, _, payload = rest[: int(own["Content-Length"])].partition(b"\r\n\r\n")
    return own, fields(http), payload


def write(pages: DataFrame, path: str, least: int = LEAST, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``path``; the index: page_id, record_id, bundle, frame, place, size."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("large", F.octet_length("payload") >= least)
    # small payloads have no group: a key of their own spreads them
    rows = rows.withColumn("key", F.when(F.col("large"), F.col("digest")).otherwise(F.concat(F.lit("-"), F.col("page_id").cast("string"))))
    rows = rows.withColumn("key", F.coalesce("key", F.lit("-")))
    groups = rows.filter("large").groupBy(F.col("digest").alias("key")).agg(
        F.max("page_id").alias("keeper"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    joined = rows.join(settled(groups, "warc-groups"), "key", "left").select("page_id", "url", "payload", "digest", "keeper")
    day = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = stream = name = None
        fs, base = file_system(path)
        for batch in batches:
            found = []
            for page_id, url, raw, digest, keeper in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or out.written >= bundle_bytes:
                    if out is not None:
                        out.close()
                        stream.close()
                    fs.create_dir(base, recursive=True)
                    name = f"pages-{uuid.uuid4().hex}.warc.zst"
                    stream = fs.open_output_stream(f"{base}/{name}", compression=None)
                    out = BundleWriter(stream, frame_bytes)
                revisit = keeper is not None and page_id != keeper
                rid = record_id(page_id, 0)
                whole = record(rid, page_id, url, raw, digest, keeper, revisit, day)
                found.append((page_id, rid, name, *out.add(whole), len(whole)))
            if found:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["page_id", "record_id", "bundle", "frame", "place", "size"])
        if out is not None:
            out.close()
            stream.close()

    return settled(joined.mapInArrow(bundles, INDEX), "warc-index")


def read(index: DataFrame, path: str) -> DataFrame:
    """The records that ``index`` names, read through it: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url, record_id, payload (null for a revisit)."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(path)
        open_name = at = source = reader = frame = None
        for batch in batches:
            rows = []
            for bundle, k, place, size in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle != open_name:
                    if source is not None:
                        source.close()
                    source = fs.open_input_file(f"{base}/{bundle}")
                    reader, open_name, at = BundleReader(source, source.size()), bundle, None
                if k != at:
                    frame, at = reader.frame(k), k
                rows.append(_row(frame[place : place + size]))
                if len(rows) >= 256:
                    yield _read_batch(rows)
                    rows = []
            if rows:
                yield _read_batch(rows)
        if source is not None:
            source.close()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, payload binary"
    return index.select("bundle", "frame", "place", "size").mapInArrow(records, schema)


def _row(raw: bytes) -> tuple:
    own, http, payload = parse(raw)
    revisit = own["WARC-Type"] == "revisit"
    if revisit:
        size, digest = int(http["Content-Length"]), base64.b32decode(own["WARC-Payload-Digest"].split(":")[1]).hex()
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    page, refers = own.get("X-Page-ID"), own.get("X-Refers-To-Page")
    return (None if page is None else int(page), size, digest, own["WARC-Type"], None if refers is None else int(refers),
            own["WARC-Target-URI"], own["WARC-Record-ID"], None if revisit else payload)


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    path = folder(spark, "warc")
    return read(write(pages, path, **options), path)
