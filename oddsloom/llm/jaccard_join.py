"""Similarity join of documents on distinct word shingles, exact, by rare-first prefix filtering.

1. One pass over the texts gives each document the size of its set and a digest of it, and counts shingles by cells
   of a table of ``2 ** sketch_bits`` cells. Documents with equal sets form one class from here on.
2. The counts, as one byte a cell (a fixed 16 MB, whatever the input), order all shingles rare first. A second pass
   takes each class's prefix: two sets with Jaccard of ``percent`` or more share a shingle in the first
   n - ceil(percent n / 100) + 1 of either. Any order gives the same links; a rare-first one gives short lists.
3. Classes meet on the shingles of their prefixes. A pair must pass the length filter, the positional filter (the
   shared place leaves room for the overlap that is needed) and the suffix filter (sets are cut into 32 ranges of the
   hash; the sum of the smaller counts bounds the overlap). It is then verified, once, with whole sets. The sets are made
   anew, for the classes of such pairs only: a table of ``2 ** WANTED_BITS`` bits (8 MB, whatever the input) tells tasks
   whose texts to read, so texts aren't shuffled.
4. Links give components by star steps. Groups of near copies aren't expanded into all pairs: first every list is
   tested against its best connected member only (the hub), twice; then, for exactness, all pairs that still share a
   prefix shingle but no component are tested. A pair left out is one whose two ends already are in one component.

Hot keys: lists are pre-aggregated and met by joins that Spark can split; sets of a hub's partners are dealt out in
salted parts of ``PART``. Copies within a class cost one row each.

Null or empty text: size 0, linked with nothing. Null doc_id: a document as any other; it joins what it links to, and
component_id is the smallest doc_id of its component, null where none has one. Rows repeating a doc_id are documents of
their own. Very long texts are read whole, in runs of rows of a few megabytes. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .hubs import connect
from .ngram_trie import slices
from .phrases import cell_marks, hash_cells, marked
from .storage import passing_tables, settled
from .words import find_words, short_hash, shingle_hashes, word_hashes

SLICE = 1 << 16  # cells of the count table sent in one row
PART = 512  # partners of a class checked in one go
RANGES = 32
TEXT_BYTES = 1 << 21  # of texts worked on at a time
WANTED_BITS = 26  # a fuller table only leaves more texts


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted hashes of its distinct shingles; a few megabytes of texts are worked on at a time."""
    for part in slices(column, TEXT_BYTES):
        words = find_words(part)
        hashes = word_hashes(words)
        shingles = shingle_hashes(hashes, k)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if b - a >= k:
                yield np.unique(shingles[a : b - k + 1])
            elif b > a:
                yield short_hash(hashes[a:b], k)
            else:
                yield np.zeros(0, np.uint64)


def node_of(found: np.ndarray) -> int:
    """The class of a set: 63 bits of its digest."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little") >> 1


def packed(found: np.ndarray) -> bytes:
    """A set to be sent: the leading 48 bits of its rising hashes, as compressed byte planes of their steps."""
    steps = np.diff(found >> np.uint64(16), prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :6].T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(6, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :6] = planes.T
    return np.cumsum(steps.view("<u8").reshape(-1))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


MEMBER_SCHEMA = "doc_id long, n long, node long, mark long, slice int, counts binary"


def mark_of(text: Column) -> Column:
    """Tells texts under one doc_id apart."""
    return F.xxhash64(text.cast("string"))


def members(docs: DataFrame, k: int, sketch_bits: int) -> DataFrame:
    """(doc_id, n, node, mark) for every document, and rows (slice, counts) of the count table."""
    shift, cells = np.uint64(64 - sketch_bits), 1 << sketch_bits
    names = [c.split()[0] for c in MEMBER_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        counts = np.zeros(cells, np.uint16)
        for batch in batches:
            sizes, nodes = [], []
            for found in shingle_sets(batch.column(1), k):
                sizes.append(len(found))
                nodes.append(node_of(found) if len(found) else None)
                cell = (found >> shift).astype(np.uint32)  # distinct hashes in one cell count once a text
                counts[cell] = np.minimum(counts[cell], 65534) + 1
            empty = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), batch.column(2), empty.cast(pa.int32()), empty.cast(pa.binary())], names)
        for s in range(0, cells, SLICE):
            if counts[s : s + SLICE].any():
                few = counts[s : s + SLICE].astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([s // SLICE], pa.int32()), pa.array([zlib.compress(few.tobytes(), 1)], pa.binary())], names)

    return settled(_texts(docs).withColumn("mark", mark_of(F.col("text"))).mapInArrow(run, MEMBER_SCHEMA), "shingle-counts")


def rarity(counted: DataFrame, sketch_bits: int) -> np.ndarray:
    """One byte a cell, larger where more shingles fell. Partial tables are summed as a stream, in two levels."""

    def adder(send):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, total = None, np.zeros(SLICE, np.int64)  # slices come one after the other

            def done() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(send(total).tobytes(), 1)], pa.binary())], ["slice", "counts"])

            for batch in batches:
                for s, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if s != now:
                        if now is not None:
                            yield done()
                        now, total = s, np.zeros(SLICE, np.int64)
                    raw = zlib.decompress(packed.as_py())
                    total += np.frombuffer(raw, "<u2" if len(raw) == 2 * SLICE else "<i8")
            if now is not None:
                yield done()

        return run

    rows = counted.filter("slice is not null").select("slice", "counts")
    dealt = rows.withColumn("salt", F.spark_partition_id() % 8).repartition("slice", "salt").sortWithinPartitions("slice").drop("salt")
    once = dealt.mapInArrow(adder(lambda x: x.astype("<i8")), "slice int, counts binary").repartition("slice").sortWithinPartitions("slice")
    ranked = once.mapInArrow(adder(lambda x: np.minimum(4 * np.log2(x + 1), 255).astype(np.uint8)), "slice int, counts binary")
    rank = np.zeros(1 << sketch_bits, np.uint8)
    for row in ranked.collect():  # 2 ** sketch_bits bytes
        rank[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
    return rank


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefixes(docs: DataFrame, k: int, percent: int, sketch_bits: int, rank: np.ndarray) -> DataFrame:
    """One row per class: node, n, prefix (its tokens in order, rarest first), ranges."""
    sent = docs.sparkSession.sparkContext.broadcast(rank.tobytes())  # 2 ** sketch_bits bytes
    shift = np.uint64(64 - sketch_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        order, seen = np.frombuffer(sent.value, np.uint8), set()
        for batch in batches:
            nodes, sizes, taken, spread = [], [], [], []
            for found in shingle_sets(batch.column(0), k):
                if not len(found) or (node := node_of(found)) in seen:
                    continue
                seen.add(node)
                key = order[found >> shift].astype(np.uint64) << np.uint64(55) | found >> np.uint64(9)
                p = prefix_size(len(key), percent)
                nodes.append(node)
                sizes.append(len(key))
                taken.append(np.sort(np.partition(key, p - 1)[:p]).astype(np.int64))
                spread.append(np.bincount((found & np.uint64(RANGES - 1)).astype(np.int64), minlength=RANGES))
            if nodes:
                ends = np.concatenate([[0], np.cumsum([len(t) for t in taken])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(taken)))
                ranges = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * RANGES), pa.array(np.concatenate(spread).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(sizes), lists, ranges], ["node", "n", "prefix", "ranges"])

    rows = _texts(docs).select("text").mapInArrow(run, "node long, n long, prefix array<long>, ranges array<int>")
    return settled(rows.dropDuplicates(["node"]), "prefixes")


def _enough(na: Column, nb: Column, percent: int) -> Column:
    """The least overlap of two sets of these sizes that link, times (100 + percent)."""
    return (na + nb) * percent


def prefixes_meet(percent: int):
    """Length and positional filter of two entries of a shared token."""

    def test(x, y) -> Column:
        nx, ny = x("n"), y("n")
        length = 100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)
        # sets with this overlap share a token that leaves room for it in both: the prefixes for this very pair
        overlap = F.ceil(_enough(nx, ny, percent) / (100 + percent))
        return length & (x("pos") <= nx - overlap) & (y("pos") <= ny - overlap)

    return test


def verify(pairs: DataFrame, docs: DataFrame, first: DataFrame, ranges: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link. ``a`` is the class that many pairs may share; ``first``: node, doc_id of a row."""
    ra = ranges.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("ranges").alias("ra"))
    rb = ranges.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("ranges").alias("rb"))
    bound = F.aggregate(F.zip_with("ra", "rb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    left = pairs.join(rb, "b").join(ra, "a").filter(bound * (100 + percent) >= _enough(F.col("na"), F.col("nb"), percent)).select("a", "b")
    with passing_tables():
        return _linked(settled(left, "pairs"), docs, first, k, percent)


def _linked(left: DataFrame, docs: DataFrame, first: DataFrame, k: int, percent: int) -> DataFrame:
    parts = left.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    partners = left.join(parts, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b")
    owners = parts.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
    asked = settled(partners.unionByName(owners), "asked")
    sets = wanted_sets(docs, asked.select("node").distinct().join(first, "node"), k)
    rows = asked.join(sets, "node").select("a", "part", "b", "found")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            links = []
            for a, b, found in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                have = unpacked(found.as_py())
                if b is None:
                    owner, own = a, have
                    continue
                assert owner == a
                both = len(own) + len(have) - len(np.union1d(own, have))
                if 100 * both >= percent * (len(own) + len(have) - both):
                    links.append((a, b))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return settled(dealt.mapInArrow(check, "a long, b long"), "links", stays=True)


def wanted_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, found) for the classes of ``wanted`` (node, doc_id of a row, null where no row has one), and for a few others:
    whole sets from whole texts. A class may come once a task."""
    wanted = settled(wanted, "wanted")
    marks = cell_marks(wanted.filter("doc_id is not null").select(F.xxhash64("doc_id").alias("hash")), WANTED_BITS)
    sent = docs.sparkSession.sparkContext.broadcast(marks.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        some, seen = np.frombuffer(sent.value, np.uint8), set()  # a row that is repeated gives its set once
        for batch in batches:
            chance = batch.column(0)
            if not chance.null_count:
                batch = batch.filter(pa.array(marked(some, hash_cells(chance.to_numpy().view(np.uint64), WANTED_BITS))))
            nodes, sets = [], []
            for found in shingle_sets(batch.column(1), k) if batch.num_rows else ():
                if len(found) and (own := node_of(found)) not in seen:
                    seen.add(own)
                    nodes.append(own)
                    sets.append(packed(found))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "found"])

    schema = "node long, found binary"
    named = _texts(docs).filter("doc_id is not null").select(F.xxhash64("doc_id").alias("chance"), "text").mapInArrow(run, schema)
    # rows without a doc_id are found by their sets
    nameless = _texts(docs).filter("doc_id is null").select(F.lit(None).cast("long").alias("chance"), "text").mapInArrow(run, schema)
    nameless = nameless.join(wanted.filter("doc_id is null").select("node"), "node", "left_semi").dropDuplicates(["node"])
    return settled(named.unionByName(nameless), "sets")


def _components(docs: DataFrame, k: int, percent: int, sketch_bits: int) -> DataFrame:
    """One row per document: doc_id, n, mark, part (its component, null for one without words); call inside passing_tables."""
    with passing_tables():
        counted = members(docs, k, sketch_bits)
        rows = settled(counted.filter("slice is null").select("doc_id", "n", "node", "mark"), "rows", stays=True)
        rank = rarity(counted, sketch_bits)
    with passing_tables():
        classes = prefixes(docs, k, percent, sketch_bits, rank)
        entries = classes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
        shared = settled(entries.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1"), "shared")
        lists = settled(entries.join(shared, "token"), "lists")
        first = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
        weight = settled(lists.groupBy("node").agg(F.sum("c").alias("weight")).join(first, "node"), "weights", stays=True)
        lists = settled(lists.join(weight, "node").select(F.col("token").alias("key"), "node", "weight", "n", "pos"), "lists", stays=True)
        ranges = settled(classes.select("node", "n", "ranges").join(weight.select("node"), "node", "left_semi"), "ranges", stays=True)
    first = weight.select("node", "doc_id")
    label = connect(lists, prefixes_meet(percent), lambda pairs: verify(pairs, docs, first, ranges, k, percent))
    named = rows.join(label, "node", "left").withColumn("part", F.coalesce("component", "node"))
    return settled(named.select("doc_id", "n", "mark", "part"), "named", stays=True)


def linked_components(docs: DataFrame, k: int = 4, percent: int = 85, sketch_bits: int = 24) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    with passing_tables():
        named = _components(docs, k, percent, sketch_bits)
        smallest = settled(named.filter("part is not null").groupBy("part").agg(F.min("doc_id").alias("least")), "smallest", stays=True)
    return named.join(smallest, "part", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("part").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, sketch_bits: int = 24) -> DataFrame:
    """One row of ``docs`` for each component, that of the smallest doc_id (rows without one come last, ties go by a hash
    of the text, and of rows alike in both any stays); rows without words all stay."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    with passing_tables():
        named = _components(docs, k, percent, sketch_bits)
        rows = named.groupBy("part", "doc_id", "mark").agg(F.count("*").alias("copies"))
        first = rows.filter("part is not null").groupBy("part").agg(F.min_by(F.struct("doc_id", "mark", "copies"), order).alias("row"))
        wordless = rows.filter("part is null").select("doc_id", "mark", F.lit(1).cast("long").alias("copies"))
        kept = settled(first.select("row.*").unionByName(wordless), "kept", stays=True)
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark"), "copies")
    whole = docs.select(F.struct("*").alias("doc"))
    id_, mark = F.col("doc.doc_id").cast("long"), mark_of(F.col("doc.text"))
    found = whole.join(kept, id_.eqNullSafe(F.col("kept_id")) & mark.eqNullSafe(F.col("kept_mark")))
    alone = found.filter("copies = 1").select("doc.*")
    repeated = found.filter("copies > 1").dropDuplicates(["kept_id", "kept_mark"]).select("doc.*")
    return alone.unionByName(repeated)
