"""Token ids in bit- or byte-plane shuffled binary files.

A shard file holds the ids of consecutive documents. Ids are cut into chunks of ``chunk`` ids; a chunk of 32-bit ids
is transposed into planes (byte plane p holds byte p of every id, bit plane p holds bit p), each plane is compressed
by itself with zstandard, and a plane of zeros is left out. Layout, integers little-endian:

    "IDPL1\\0" + kind (1 byte: 8 byte planes, 1 bit planes) + 0
    planes of all chunks, one after the other
    chunk index: for each chunk first id (u64), ids (u32), place (u64), bytes of each plane (u32 each, 0: all zero)
    document index: for each document first id within the shard (u64)
    footer: chunks (u64), documents (u64), ids (u64), place of the chunk index (u64), "IDPLEND\\0"

Writing: documents are range-partitioned by doc_id, so shards hold ascending doc_ids; a task encodes its documents and
writes one shard under a name of its own attempt, and the table of shards names the files of the attempts that
counted. Reading: a task takes a run of chunks, reads the index and those chunks alone, and gives the ids of each
document's part in them.

Null text: an empty document, its end id alone. Null doc_ids come first. Repeated rows are written each. Empty table:
no shard and no rows. Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import file_system, folder, settled
from .tokens import default_vocabulary, encoded

MAGIC, TAIL = b"IDPL1\0", b"IDPLEND\0"
FOOTER, FOOTER_BYTES = "<QQQQ8s", struct.calcsize("<QQQQ8s")
SHARDS = "shard string, first_doc long, null_doc boolean, docs long, ids long, doc_ids binary, doc_nulls binary"


def planes(ids: np.ndarray, kind: int) -> np.ndarray:
    """Rows are the planes of the ids' 32 bits."""
    octets = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    if kind == 8:
        return np.ascontiguousarray(octets)
    bits = np.unpackbits(np.ascontiguousarray(octets), axis=1, bitorder="little").reshape(4, -1, 8)
    return np.packbits(bits.transpose(0, 2, 1).reshape(32, -1), axis=1, bitorder="little")


def ids_of(rows: np.ndarray, n: int, kind: int) -> np.ndarray:
    """The inverse of ``planes`` for n ids."""
    if kind == 8:
        return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)[:n]
    bits = np.unpackbits(rows, axis=1, count=n, bitorder="little").reshape(4, 8, n).transpose(0, 2, 1)
    return np.ascontiguousarray(np.packbits(bits, axis=2, bitorder="little").reshape(4, n).T).view("<u4").reshape(-1)


class Writer:
    """Writes one shard; ids may be added in runs of any length."""

    def __init__(self, out: BinaryIO, kind: int = 8, chunk: int = 1 << 16, level: int = 1):
        self.out, self.kind, self.chunk, self.press = out, kind, chunk, zstandard.ZstdCompressor(level=level)
        self.place, self.ids, self.waiting, self.n_waiting = 0, 0, [], 0
        self.chunks, self.docs = [], []
        self._put(MAGIC + bytes([kind, 0]))

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.place += len(raw)

    def document(self, ids: bytes) -> None:
        self.docs.append(self.ids + self.n_waiting)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= self.chunk:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        at = 0
        while len(ids) - at >= self.chunk or last and at < len(ids):
            part = ids[at : at + self.chunk]
            packed = [self.press.compress(p.tobytes()) if p.any() else b"" for p in planes(part, self.kind)]
            self.chunks.append(struct.pack(f"<QIQ{len(packed)}I", self.ids, len(part), self.place, *map(len, packed)))
            self._put(b"".join(packed))
            self.ids += len(part)
            at += len(part)
        self.waiting, self.n_waiting = [ids[at:].tobytes()], len(ids) - at

    def close(self) -> None:
        self._flush(True)
        index = self.place
        self._put(b"".join(self.chunks) + np.array(self.docs, "<u8").tobytes())
        self._put(struct.pack(FOOTER, len(self.chunks), len(self.docs), self.ids, index, TAIL))


class Reader:
    """Random access to a shard by chunk or by range of ids."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - FOOTER_BYTES)
        n_chunks, n_docs, self.ids, index, tail = struct.unpack(FOOTER, file.read(FOOTER_BYTES))
        file.seek(0)
        head = file.read(8)
        if head[:6] != MAGIC or tail != TAIL:
            raise ValueError("not a shard of id planes")
        self.kind = head[6]
        n_planes = 4 if self.kind == 8 else 32
        file.seek(index)
        chunk = np.dtype([("first", "<u8"), ("ids", "<u4"), ("place", "<u8"), ("sizes", "<u4", (n_planes,))])
        self.chunks = np.frombuffer(file.read(n_chunks * chunk.itemsize), chunk)
        self.docs = np.frombuffer(file.read(8 * n_docs), "<u8").astype(np.int64)

    def chunk(self, k: int) -> np.ndarray:
        entry = self.chunks[k]
        n, sizes = int(entry["ids"]), entry["sizes"].tolist()
        self.file.seek(int(entry["place"]))
        raw, at, rows = self.file.read(sum(sizes)), 0, []
        width = n if self.kind == 8 else (n + 7) // 8
        for size in sizes:
            plane = zstandard.ZstdDecompressor().decompress(raw[at : at + size]) if size else bytes(width)
            rows.append(np.frombuffer(plane, np.uint8))
            at += size
        return ids_of(np.stack(rows), n, self.kind)

    def range(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.zeros(0, "<u4")
        first = self.chunks["first"].astype(np.int64)
        a, b = int(np.searchsorted(first, start, "right")) - 1, int(np.searchsorted(first, end))
        return np.concatenate([self.chunk(k) for k in range(a, b)])[start - first[a] : end - first[a]]


def write(docs: DataFrame, path: str, kind: int = 8, chunk: int = 1 << 16, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) below ``path``; the table of shards, in ascending doc_id order by
    (null_doc descending, first_doc)."""
    vocabulary = vocabulary or default_vocabulary()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        doc_ids: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs, base = file_system(path)
                fs.create_dir(base, recursive=True)
                name = f"ids-{uuid.uuid4().hex}.plane"
                stream = fs.open_output_stream(f"{base}/{name}", compression=None)
                out = Writer(stream, kind, chunk)
            doc_ids.extend(batch.column(0).to_pylist())
            for _, ids in encoded(batch.column(1), vocabulary, end_id):
                out.document(ids)
        if out is not None:
            out.close()
            stream.close()
            null = np.array([d is None for d in doc_ids])
            known = np.array([0 if d is None else d for d in doc_ids], "<i8")
            yield pa.RecordBatch.from_pylist([{
                "shard": name, "first_doc": doc_ids[0], "null_doc": doc_ids[0] is None, "docs": len(doc_ids),
                "ids": out.ids, "doc_ids": zlib.compress(known.tobytes(), 1), "doc_nulls": zlib.compress(np.packbits(null).tobytes(), 1),
            }], schema=pa.schema([("shard", pa.string()), ("first_doc", pa.int64()), ("null_doc", pa.bool_()), ("docs", pa.int64()), ("ids", pa.int64()), ("doc_ids", pa.binary()), ("doc_nulls", pa.binary())]))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return settled(ordered.mapInArrow(shard, SHARDS), "id-shards")


def read(spark: SparkSession, shards: DataFrame, path: str) -> DataFrame:
    """Documents read back from the files: doc_id, start (over all shards), n_tokens, ids (little-endian)."""
    earlier = Window.orderBy(F.desc("null_doc"), "first_doc").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.select(  # one small row per shard; the packed doc_ids meet it again by name
        "shard", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).cast("long").alias("before"))
    jobs = shards.select("shard", "docs", "doc_ids", "doc_nulls").join(placed, "shard")

    def open_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(path)
        for batch in batches:
            for job in batch.to_pylist():
                file = f"{base}/{job['shard']}"
                doc_ids = np.frombuffer(zlib.decompress(job["doc_ids"]), "<i8")
                nulls = np.unpackbits(np.frombuffer(zlib.decompress(job["doc_nulls"]), np.uint8), count=len(doc_ids)).astype(bool)
                with fs.open_input_file(file) as source:
                    yield from _documents(Reader(source, source.size()), doc_ids, nulls, job["before"])

    # one shard a row: spread them, they are few rows and much work
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return jobs.repartition(tasks, "shard").mapInArrow(open_shards, "doc_id long, start long, n_tokens long, ids binary")


def _documents(reader: Reader, doc_ids: np.ndarray, nulls: np.ndarray, before: int) -> Iterator[pa.RecordBatch]:
    """Reads chunk after chunk; at most a chunk and one document's ids are held."""
    ends = np.append(reader.docs[1:], reader.ids)
    held, place, chunk, rows = np.zeros(0, "<u4"), 0, 0, []
    for doc, (start, end) in enumerate(zip(reader.docs.tolist(), ends.tolist())):
        if place + len(held) < end:
            parts = [held[start - place :]]
            have = place + len(held)
            while have < end:
                parts.append(reader.chunk(chunk))
                have += len(parts[-1])
                chunk += 1
            held, place = np.concatenate(parts), start
        ids = held[start - place : end - place].tobytes()
        rows.append((None if nulls[doc] else int(doc_ids[doc]), before + start, end - start, ids))
        if len(rows) >= 512:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "start", "n_tokens", "ids"])


def round_trip(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Write and read back: the table of documents that the files hold."""
    path = folder(spark, "id-planes")
    return read(spark, write(docs, path, **options), path)
