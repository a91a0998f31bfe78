"""Exact deduplication by two-pass Bloom filtering.

Pass one hashes every text and fills a filter of cells: a cell is marked when at least two rows fall into it. Tasks
send the cells of their own rows (each once, with a mark where it was hit twice), so what is shuffled for the filter
is a few bytes a row, whatever the size of a group of copies. Pass two looks every row up: a row whose cell is not
marked has no equal and passes straight through; only the rest are shuffled by their SHA-256 and compared.

The filter holds ``bits_per_row`` bits for each row, and at most ``filter_bits`` (32 MB) at a time, which is the most
that is sent to the driver and broadcast. A larger table is treated in waves: wave w holds the rows whose hash is w
modulo the number of waves, each with its own filter, over a table of hashes partitioned by wave; the work stays in
proportion to the rows.

Null text counts as empty. Of equal texts the row with the largest doc_id stays (null doc_ids last; of rows that
repeat both text and doc_id one stays). Empty table: no rows. Other columns are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import settled

FILTER_BITS = 1 << 28
BITS_PER_ROW = 32
SLICE_BITS = 1 << 18  # one slice of the filter is 32 KB


def sha256(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256)


def hashed(sha: Column | str) -> Column:
    """63 bits of a SHA-256 in hex, as a long."""
    return F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")


def repeated_cells(hashes: DataFrame, bits: int) -> bytes:
    """The filter over a column ``h``: bit h mod ``bits`` is set where two rows or more have that cell."""
    slices = max(1, bits // SLICE_BITS)
    width = bits // slices

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False) % bits, return_counts=True)
            cuts = np.searchsorted(cells, np.arange(slices + 1) * width)
            out = [(s, ((cells[a:b] - s * width) * 2 + (n[a:b] > 1)).astype("<u4").tobytes())
                   for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([c for _, c in out], pa.binary())], ["slice", "cells"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                code = np.frombuffer(cells.as_buffer(), "<u4")
                if s not in once:
                    once[s], twice[s] = np.zeros(width, bool), np.zeros(width, bool)
                at = code >> 1
                twice[s][at[(code & 1 == 1) | once[s][at]]] = True
                once[s][at] = True
        for s, marked in twice.items():
            if marked.any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zlib.compress(np.packbits(marked).tobytes(), 1)], pa.binary())], ["slice", "cells"])

    sent = hashes.select("h").mapInArrow(local, "slice int, cells binary").repartition("slice").mapInArrow(merged, "slice int, cells binary")
    found = bytearray(bits // 8)
    for row in sent.collect():  # at most bits / 8 bytes
        found[row["slice"] * width // 8 : (row["slice"] + 1) * width // 8] = zlib.decompress(row["cells"])
    return bytes(found)


def plan_filter(rows: int, filter_bits: int = FILTER_BITS, bits_per_row: int = BITS_PER_ROW) -> tuple[int, int]:
    """(bits of a filter, number of waves) for a table of ``rows``; bits is a power of two."""
    wanted = max(SLICE_BITS, 1 << (max(1, rows) * bits_per_row - 1).bit_length())
    bits = min(wanted, filter_bits)
    return bits, wanted // bits


def marks(hashes: DataFrame, bits: int):
    """A function of the hash column that may be true of rows without an equal, and is of all others."""
    sent = hashes.sparkSession.sparkContext.broadcast(repeated_cells(hashes, bits))

    @F.pandas_udf("boolean")
    def marked(h: pd.Series) -> pd.Series:
        cell = h.to_numpy() % bits
        return pd.Series(np.frombuffer(sent.value, np.uint8)[cell >> 3] >> (7 - (cell & 7)) & 1 == 1)

    return marked


def duplicate_groups(docs: DataFrame, filter_bits: int = FILTER_BITS, bits_per_row: int = BITS_PER_ROW) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sha256().alias("text_sha256"))
    keys = settled(keys.select("*", hashed("text_sha256").alias("h"), F.monotonically_increasing_id().alias("row")), "dedup-keys")
    bits, waves = plan_filter(keys.count(), filter_bits, bits_per_row)
    out = None
    for wave in range(waves):
        own = keys.filter(F.pmod("h", F.lit(waves)) == wave).withColumn("h", F.expr(f"h div {waves}")) if waves > 1 else keys
        tested = own.withColumn("maybe", marks(own, bits)(F.col("h")))
        alone = tested.filter(~F.col("maybe")).select(
            "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
        rest = tested.filter("maybe")
        groups = rest.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
        joined = rest.join(settled(groups, "dedup-groups"), "text_sha256").select(
            "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256")
        part = alone.unionByName(joined)
        out = part if out is None else out.unionByName(part)
    return out


def drop_duplicates(docs: DataFrame, filter_bits: int = FILTER_BITS, bits_per_row: int = BITS_PER_ROW) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows without an equal are not shuffled.

    The texts are read twice: for the filter and for the result. There is one filter, of ``filter_bits`` at most; a
    table that would need more keeps its result, with a larger share of rows shuffled. The rest meets its groups'
    kept rows by (hash, doc_id), so a large group of copies is spread over all tasks.
    """
    hashes = settled(docs.select(hashed(sha256()).alias("h")), "dedup-hashes")
    rows = hashes.count()
    bits = plan_filter(rows, filter_bits, bits_per_row)[0]
    test = marks(hashes, bits)
    row = docs.select(F.struct("*").alias("doc"), sha256().alias("sha"))
    row = row.withColumn("id", F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(-(2**63))))
    row = row.withColumn("maybe", test(hashed("sha")))
    rest = row.filter("maybe")
    keep = settled(rest.groupBy("sha").agg(F.max("id").alias("id")), "dedup-keep")
    same = Window.partitionBy("sha", "id").orderBy("sha")
    stay = rest.join(keep, ["sha", "id"], "left_semi").withColumn("n", F.row_number().over(same)).filter("n = 1")
    return row.filter(~F.col("maybe")).select("doc.*").unionByName(stay.select("doc.*"))
