"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the binary digits of n, the full context first: as many
pieces of ``context`` tokens as fit, then one piece for each set bit of the rest, longest first. Pieces of one
length form a bucket; each piece is one sequence of that bucket, so no sequence holds two documents and none has
padding. A training batch is drawn from one bucket, with as many sequences as its length allows.

Every piece comes from its document's row alone, so the job is one pass without a shuffle, and a lost task is redone
from its file split.

``sequence_id`` is unique. With ``place``, a column of different numbers from 0 on, it rises with the place and, within a document,
with the start: the place in the high bits, the piece's number in as many low bits as the longest string needs.

Null or empty text: the document is its end id alone, one piece of length 1. Null doc_id: kept. Repeated rows: each
row is a document of its own with its own sequences. Empty table: no pieces. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import default_vocabulary, encoded

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, ordered long"
ROWS = 4096  # pieces sent at a time


def binary_lengths(n: int, context: int) -> list[int]:
    """Lengths of the pieces of n tokens, in the order they are cut; ``context`` is a power of two."""
    rest = n % context
    bits = [1 << b for b in range(context.bit_length() - 2, -1, -1) if rest >> b & 1]
    return [context] * (n // context) + bits


def piece_bits(context: int) -> int:
    """Bits that number the pieces of any document: a string has fewer than 2^31 tokens."""
    return ((1 << 31) // context + context.bit_length()).bit_length()


def pack(docs: DataFrame, context: int = 1024, vocabulary: str | None = None, end_id: int = 0, place: str | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, start, length, doc_tokens, ids (unsigned 32-bit little-endian),
    sequence_id, offset, bucket (the length's power of two), sequence_length."""
    if context < 1 or context & (context - 1):
        raise ValueError("context must be a power of two")
    vocabulary = vocabulary or default_vocabulary()
    bits = piece_bits(context)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, places, rows = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for i, ids in encoded(batch.column(1), vocabulary, end_id):
                n, start = len(ids) // 4, 0
                first = None if places[i] is None else places[i] << bits
                for k, length in enumerate(binary_lengths(n, context)):
                    rows.append((doc_ids[i], start, length, n, ids[4 * start : 4 * (start + length)], None if first is None else first + k))
                    start += length
                if len(rows) >= ROWS:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    at = (F.lit(None) if place is None else F.col(place)).cast("long").alias("place")
    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), at).mapInArrow(cut, PIECES)
    return pieces.select(
        "doc_id", "start", "length", "doc_tokens", "ids",
        (F.monotonically_increasing_id() if place is None else F.col("ordered")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.log2("length").cast("int").alias("bucket"),
        F.col("length").alias("sequence_length"),
    )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "ordered"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def id_list(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")


def digest(ids: Column) -> Column:
    """The unsigned crc32 of the ids' bytes."""
    return F.crc32(ids)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per bucket, so that a loader reads sequences of one length."""
    pieces.write.partitionBy("bucket").parquet(path)
