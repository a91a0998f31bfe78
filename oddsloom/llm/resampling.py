"""Resampling towards a target distribution: importance weights of hashed n-grams, Gumbel top-k by a distributed quickselect.

Features of a text are its runs of 1 to ``grams`` consecutive words, joined by one space, repeats counted; a feature's
bucket is the crc32 of its UTF-8 bytes modulo ``buckets``. With s of S features of the raw corpus and t of T of the target
in a bucket, its gain is floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))). A row's weight is the floored mean of its
features' gains, read from an array by the whole batch's buckets at once. Its score is the weight and a Gumbel draw from
sha256("seed:doc_id"), so the highest scores are a sample without replacement in proportion to exp(weight / 1000).

The k highest scores are found without sorting all rows. Rows have a composite key (falling score, rising doc_id, row
number), no two alike. Each round takes some pivot keys at random from the open range, counts the open rows below, at and
above every pivot in one aggregation, and keeps the range between the two pivots around the k-th key; it ends when a pivot
is the k-th key. Only rows up to that key are sorted, in ranges, and ranked by the counts of the ranges before.

Driver and tasks hold ``buckets`` numbers and ``PIVOTS`` keys; no step has a group of rows.

Null or empty text, or no word: no feature, weight 0. Null doc_id: drawn as the text "seed:", after all ids in a tie.
Repeated rows and doc_ids: rows of their own, each with its place; among equal (score, doc_id) any comes first. Long texts
are read whole, in runs of rows of a few megabytes. Empty documents: no rows. Empty target: gains from s alone. Other
columns aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngram_trie import slices
from .storage import settled
from .words import NO_LETTER, Words, find_words

PIVOTS = 32
LONG_WORD = 64  # bytes of a word that are hashed column by column; zlib takes the rest
FIRST = (1 << 33) - 1


def _crc_table() -> np.ndarray:
    """The remainders of all bytes for the polynomial of crc32."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out.astype(np.uint32)


TABLE = _crc_table()


def crcs(words: Words, before: np.ndarray | None = None) -> np.ndarray:
    """crc32 of every word, going on from the crc32s ``before`` where given: one byte of all words at a time."""
    size = words.ends - words.starts
    order = np.argsort(-size, kind="stable")
    left = np.searchsorted(-size[order], -np.arange(min(LONG_WORD, int(size.max(initial=0)))), side="left")
    starts = words.starts[order]
    now = np.zeros(len(size), np.uint32) if before is None else before[order].astype(np.uint32)
    now = ~now
    for j, n in enumerate(left.tolist()):  # n words have more than j bytes
        byte = words.data[starts[:n] + j]
        now[:n] = TABLE[(now[:n] ^ byte) & 0xFF] ^ (now[:n] >> 8)
    now = ~now
    for i in np.flatnonzero(size[order] > LONG_WORD).tolist():
        w = order[i]
        now[i] = zlib.crc32(words.data[words.starts[w] + LONG_WORD : words.ends[w]].tobytes(), int(now[i]))
    out = np.empty_like(now)
    out[order] = now
    return out


def _tail(words: Words, keep: slice) -> Words:
    return Words(words.data, words.starts[keep], words.ends[keep], words.first)


def features(column: pa.Array, grams: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, the row of each, and the rows' numbers of words."""
    words = find_words(column, breaks=NO_LETTER)
    n = np.diff(words.first)
    row = np.repeat(np.arange(len(n)), n)
    crc = crcs(words)
    found, rows = [crc], [row]
    for g in range(1, grams):
        if len(row) <= g:
            break
        crc = ~crc[:-1]
        crc = ~(TABLE[(crc ^ np.uint32(0x20)) & 0xFF] ^ (crc >> 8))  # and a space
        crc = crcs(_tail(words, slice(g, None)), crc)
        inside = row[g:] == row[:-g]
        found.append(crc[inside])
        rows.append(row[g:][inside])
    return (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.concatenate(rows), n


def bucket_counts(texts: DataFrame, grams: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for column in slices(batch.column(0)):
                total += np.bincount(features(column, grams, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket in thousandths, in doubles."""
    b, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def gumbel(seed: int, doc_id: Column) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256("seed:doc_id")."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gain: np.ndarray, grams: int = 2, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and a row number for every row of ``docs``, as a settled table."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            at = 0
            for column in slices(batch.column(1)):
                bucket, row, n = features(column, grams, len(own))
                many = np.bincount(row, minlength=len(n))
                total = np.zeros(len(n), np.int64)
                np.add.at(total, row, own[bucket])
                mean = np.where(many > 0, total // np.maximum(many, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(column)), *(pa.array(x.astype(np.int64)) for x in (n, many, mean))],
                    ["doc_id", "n_words", "n_features", "weight"])
                at += len(column)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    rows = rows.withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id")))
    return settled(rows.withColumn("row", F.monotonically_increasing_id()), "scored", stays=True)


def sort_key() -> list[Column]:
    """The composite key: highest score, then smallest doc_id (null last), then row number."""
    return [(-F.col("score")).alias("k1"), F.col("doc_id").isNull().alias("k2"), F.coalesce("doc_id", F.lit(0)).alias("k3"), F.col("row").alias("k4")]


def _pivot(key: tuple) -> Column:
    kinds = ("long", "boolean", "long", "long")
    return F.struct(*[F.lit(v).cast(kind).alias(f"k{i}") for i, (v, kind) in enumerate(zip(key, kinds), 1)])


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS) -> tuple:
    """The k-th smallest composite key of ``rows`` (k from 1 to their number)."""
    keys = rows.select(F.struct(*sort_key()).alias("key"), "score")
    low = high = None
    turn = 0
    while True:
        turn += 1
        still = keys
        if low is not None:
            still = still.filter(F.col("score") <= -low[0]).filter(F.col("key") > _pivot(low))
        if high is not None:
            still = still.filter(F.col("score") >= -high[0]).filter(F.col("key") < _pivot(high))
        drawn = still.orderBy(F.xxhash64(F.lit(turn), "key.k4"), "key.k4").limit(pivots).select("key.*").collect()
        drawn = sorted(tuple(r) for r in drawn)
        counted = still.agg(*[F.count_if(F.col("key") < _pivot(p)).alias(f"b{i}") for i, p in enumerate(drawn)],
                            *[F.count_if(F.col("key") == _pivot(p)).alias(f"e{i}") for i, p in enumerate(drawn)]).first()
        skip, next_low, next_high = 0, None, None
        for i, p in enumerate(drawn):
            below, at = counted[f"b{i}"], counted[f"e{i}"]
            if below < k <= below + at:
                return p
            if below + at < k:
                skip, next_low = below + at, p
            elif next_high is None:
                next_high = p
        k, low, high = k - skip, next_low or low, next_high or high


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with rank, their place by the composite key from 1: sorted by ranges, each counted from the one before."""
    kept = rows.columns
    keyed = rows.withColumn("key", F.struct(*sort_key()))
    placed = keyed.repartitionByRange("key").sortWithinPartitions("key").select(*kept, F.monotonically_increasing_id().alias("place"))
    placed = settled(placed, "winners", stays=True)
    sizes = placed.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n")).collect()  # a row a range
    start, starts = 0, []
    for r in sorted(sizes):
        starts.append((r["part"], start))
        start += r["n"]
    before = rows.sparkSession.createDataFrame(starts, "part long, start long")
    numbered = placed.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(before), "part")
    return numbered.select(*kept, (F.col("start") + F.col("place").bitwiseAND(FIRST) + 1).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, grams: int = 2, buckets: int = 10000, least_words: int = 20, percent: int = 25, seed: int = 7,
) -> DataFrame:
    """Every row of ``docs``: doc_id, n_features, weight, score, rank. Of the N rows with ``least_words`` words the floor(percent N / 100)
    highest scores are drawn and ranked from 1; rank is null for all other rows. ``target`` has a column text."""
    gain = gains(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets))
    every = scored(docs, gain, grams, seed)
    able = every.filter(F.col("n_words") >= least_words)
    k = able.count() * percent // 100
    out = every.withColumn("rank", F.lit(None).cast("long"))
    if k:
        wins = (F.col("n_words") >= least_words) & (F.struct(*sort_key()) <= _pivot(kth_key(able, k)))
        out = ranked(every.filter(wins)).unionByName(out.filter(~wins))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows' doc_id, score and rank; join them to whatever table holds the texts."""
    return resample(docs, target, **options).filter("rank is not null").select("doc_id", "score", "rank")
