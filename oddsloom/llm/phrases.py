"""Collocations: phrases of 2 to 4 words mined level by level with double-array tries of Apriori-safe candidates.

1. Words are counted by 64-bit keys, hashes of language and word; those of ``least`` occurrences or more are the frequent
   phrases of one word. The texts are then written once as runs of keys, cut at piece ends and other words; all later passes
   but the last, which names the words of the first phrases, read these. Rows and Parquet pages of runs are small: large ones
   fill the executors' memory outside their heaps with buffers and their heaps with objects that span regions.
2. For each length n a candidate is a phrase that occurs, whose two parts of n - 1 words are both frequent (only such a
   phrase can be), and whose cell of a count sketch reached ``least`` (a sketch counts no phrase too low, so neither test
   loses one). The sketch has about one cell for 16 words, 2^24 at most; a fuller one only leaves more candidates.
3. Candidates go to a double-array trie over the keys' ranks, spelled as bytes, which is broadcast. numpy advances the
   states of all text positions together, one word after the other, drops those that fall out, and bincounts the
   accepting states; the tasks' counts are summed. A trie holds about ``TRIE`` candidates: more are dealt by their hash to
   several tries, each broadcast, walked in a pass of its own over the keys, and destroyed before the next is made.
4. Scores, the test against longer phrases and the ranks are joins and aggregations of the frequent phrases.

Hot words: counts are combined in tasks before any shuffle, a phrase is one row a task at most, joins are left to Spark's
skew splitting and the ranks to its limit within tasks.

Null text: empty. Null lang: "und", together with documents of that name. Null doc_id, repeated rows: every row counts. Very
long texts are counted whole, in runs of a few megabytes of texts. Empty table, or nothing frequent: no rows. Ties end
with the phrase in byte order. Other columns aren't read. Keys are told apart by 64 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import double_array, tokens
from .ngram_trie import slices
from .storage import passing_tables, settled
from .words import find_words, mix, shingle_hashes, word_hashes

U = np.uint64
LONGEST = 4
TRIE = 200_000  # candidates of a trie
SLICE = 1 << 16  # cells of a sketch in a row
MOST_BITS = 24
TEXT_BYTES = 1 << 21  # of texts worked on at a time
RUN_KEYS = 1 << 15  # keys of a row of runs, but for a longer run
WORKED = 1 << 18  # keys of runs worked on at a time
HELD = 1 << 18  # word or phrase keys that a task holds before it sends them
NAMED = 4_000_000  # keys whose words are looked up in one pass
BREAKS = np.zeros(256, bool)  # between words
ENDS = np.zeros(256, bool)  # of pieces
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BREAKS[[0x20, 0x09]] = True
BREAKS |= ENDS
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def batch_of(schema: str, *columns) -> pa.RecordBatch:
    names = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) if not isinstance(c, pa.Array) else c for c, (_, k) in zip(columns, names)], [n for n, _ in names])


def _language(lang: str) -> np.uint64:
    return U(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def language_hashes(langs: pa.Array) -> np.ndarray:
    names = langs.dictionary_encode()
    return np.array([_language(x) for x in names.dictionary.to_pylist()], U)[names.indices.to_numpy()]


def language_names(docs: DataFrame) -> DataFrame:
    """lang (hash), name of every language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch_of("lang long, name string", language_hashes(batch.column(0)).view(np.int64), batch.column(0))

    return settled(_source(docs).select("lang").distinct().mapInArrow(run, "lang long, name string"), "languages")


def keyed_words(langs: pa.Array, texts: pa.Array):
    """The words of a batch, their keys (never 0), each one's row, and whether a word goes on in the piece of the one before."""
    words = find_words(texts, breaks=BREAKS)
    row = np.repeat(np.arange(len(texts)), np.diff(words.first))
    keys = mix(word_hashes(words) ^ language_hashes(langs)[row])
    keys[keys == 0] = 1
    ends = np.concatenate([[0], np.cumsum(ENDS[words.data])])
    joined = np.zeros(len(row), bool)
    joined[1:] = (row[1:] == row[:-1]) & (ends[words.starts[1:]] == ends[words.starts[:-1]])
    return words, keys, row, joined


def _strings(words, which: np.ndarray) -> pa.Array:
    """Some words as an Arrow array."""
    starts, size = words.starts[which], words.ends[which] - words.starts[which]
    offsets = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size) + np.repeat(starts, size)
    return pa.Array.from_buffers(pa.large_string(), len(which), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(words.data[place].tobytes())]).cast(pa.string())


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    for batch in batches:
        at = 0
        for texts in slices(batch.column(1), TEXT_BYTES):
            yield batch.column(0).slice(at, len(texts)), texts
            at += len(texts)
    tokens.release()  # a worker that waits for its next task holds none of this one's


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of some parts (keys, languages, counts), with their counts added up."""
    keys, lang, n = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], lang[order[first]], np.add.reduceat(n[order], first)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang (the language's hash), key, n for every word of every language."""
    schema = "lang long, key long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        held, size = [], 0

        def send() -> pa.RecordBatch:
            keys, lang, n = _merged(held)
            return batch_of(schema, lang.view(np.int64), keys.view(np.int64), n)

        for langs, texts in _each(batches):
            _, keys, row, _ = keyed_words(langs, texts)
            if not len(keys):
                continue
            found, first, n = np.unique(keys, return_index=True, return_counts=True)
            held.append((found, language_hashes(langs)[row[first]], n))
            size += len(found)
            if size > HELD:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    counts = _source(docs).mapInArrow(run, schema).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    return settled(counts, "word-counts")


def words_of(docs: DataFrame, wanted: DataFrame, most: int = NAMED) -> DataFrame:
    """key, word for the keys of ``wanted``: the texts are read once for every ``most`` keys."""
    groups, out = max(1, -(-wanted.count() // most)), None
    for g in range(groups):
        own = wanted.filter(F.pmod(F.xxhash64("key"), F.lit(groups)) == g).toArrow().column(0).to_numpy()
        sent = docs.sparkSession.sparkContext.broadcast(np.sort(own.view(U)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            open_ = sent.value  # keys that this task hasn't named
            for langs, texts in _each(batches):
                if not len(open_):
                    continue
                words, keys, _, _ = keyed_words(langs, texts)
                place = np.minimum(np.searchsorted(open_, keys), len(open_) - 1)
                at = np.flatnonzero(open_[place] == keys)
                found, first = np.unique(keys[at], return_index=True)
                if len(found):
                    yield batch_of("key long, word string", found.view(np.int64), _strings(words, at[first]))
                    open_ = np.setdiff1d(open_, found, assume_unique=True)

        part = _source(docs).mapInArrow(run, "key long, word string")
        out = part if out is None else out.unionByName(part)
    return settled(out.groupBy("key").agg(F.min("word").alias("word")), "names")


def hash_cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U(64 - bits)).astype(np.int64)


def cell_marks(frequent: DataFrame, bits: int) -> np.ndarray:
    """A bit for each cell of 2 ** bits that a frequent phrase's hash falls into, packed."""
    cell = F.shiftrightunsigned("hash", 64 - bits)
    rows = frequent.select(F.shiftright(cell, 16).alias("slice"), (cell % SLICE).cast("int").alias("cell"))
    return _packed(rows.groupBy("slice").agg(F.collect_set("cell").alias("cells")), bits)  # a slice has at most SLICE cells


def _packed(rows: DataFrame, bits: int) -> np.ndarray:
    """Bits of the cells named by rows (slice, cells)."""
    schema = "slice long, bits binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cells in batch.column(1):
                flags = np.zeros(SLICE, bool)
                flags[np.asarray(cells.values)] = True
                out.append(np.packbits(flags).tobytes())
            yield batch_of(schema, batch.column(0), out)

    return _assembled(rows.mapInArrow(run, schema), bits)


def _assembled(rows: DataFrame, bits: int) -> np.ndarray:
    marks = np.zeros(max(1, (1 << bits) >> 16) * SLICE // 8, np.uint8)
    for r in rows.collect():  # 2 ** bits bits in all
        marks[r["slice"] * SLICE // 8 : (r["slice"] + 1) * SLICE // 8] = np.frombuffer(r["bits"], np.uint8)
    return marks


def marked(marks: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (marks[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1


def rows_of_runs(runs: np.ndarray) -> Iterator[np.ndarray]:
    """Whole runs, each begun by a 0, in rows of at most ``RUN_KEYS`` keys; a longer run is a row."""
    starts, at = np.append(np.flatnonzero(runs == 0), len(runs)), 0
    while at < len(runs):
        to = starts[np.searchsorted(starts, at + RUN_KEYS, side="right") - 1]
        to = int(to if to > at else starts[np.searchsorted(starts, at, side="right")])
        yield runs[at:to]
        at = to


def key_runs(docs: DataFrame, frequent: np.ndarray, bits: int) -> DataFrame:
    """The texts as runs of the keys of frequent words with 0 before each run; see ``rows_of_runs``."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)  # 2 ** bits bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        pack = zstandard.ZstdCompressor(level=1)
        for langs, texts in _each(batches):
            _, keys, _, joined = keyed_words(langs, texts)
            some = marked(sent.value, hash_cells(keys, bits))
            before = np.concatenate([[False], some[:-1]]) & joined  # goes on from a frequent word
            after = np.concatenate([before[1:] & some[1:], [False]])
            kept = some & (before | after)  # a word alone is no part of a phrase
            first = np.flatnonzero(kept & ~before)
            runs = np.insert(keys[kept], (np.cumsum(kept) - 1)[first], U(0))
            for own in rows_of_runs(runs):
                yield batch_of("keys binary", [pack.compress(np.ascontiguousarray(own.view(np.uint8).reshape(-1, 8).T).tobytes())])

    return settled(_source(docs).mapInArrow(run, "keys binary"), "key-runs", small_pages=True)


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The runs of some rows together."""
    unpack, held, size = zstandard.ZstdDecompressor(), [], 0
    for batch in batches:
        for raw in batch.column(0):
            planes = np.frombuffer(unpack.decompress(raw.as_py()), np.uint8).reshape(8, -1)
            held.append(np.ascontiguousarray(planes.T).view(U).reshape(-1))
            size += len(held[-1])
            if size >= WORKED:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)
    tokens.release()


def phrase_hashes(keys: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n keys; a run of one is its key."""
    return keys if n == 1 else shingle_hashes(keys, n)


def safe_windows(keys: np.ndarray, n: int, frequent: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases of n words begin whose both parts of n - 1 words may be frequent, and their hashes."""
    if len(keys) < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    whole = np.ones(len(keys) - n + 1, bool)
    for d in range(n):
        whole &= keys[d : len(keys) - n + 1 + d] != 0
    at = np.flatnonzero(whole)
    if n > 2:
        part = marked(frequent, hash_cells(phrase_hashes(keys, n - 1), bits))
        at = at[part[at] & part[at + 1]]
    return at, phrase_hashes(keys, n)[at]


def sketch(runs: DataFrame, n: int, least: int, frequent: np.ndarray, bits: int) -> np.ndarray:
    """A bit for each cell that ``least`` phrases of n words fell into, packed."""
    sent = runs.sparkSession.sparkContext.broadcast(frequent)
    schema, cells = "slice long, counts binary", max(SLICE, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        counts = np.zeros(cells, "<u2")  # 65535 stands for any larger count
        for keys in runs_of(batches):
            cell, times = np.unique(hash_cells(safe_windows(keys, n, sent.value, bits)[1], bits), return_counts=True)
            counts[cell] = np.minimum(counts[cell] + times, 65535)
        pack = zstandard.ZstdCompressor(level=1)
        for s in range(cells // SLICE):
            few = counts[s * SLICE : (s + 1) * SLICE]
            if few.any():
                yield batch_of(schema, [s], [pack.compress(few.tobytes())])
        del counts, few
        tokens.release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, now, total = zstandard.ZstdDecompressor(), None, np.zeros(SLICE, np.uint64)

        def done() -> pa.RecordBatch:
            return batch_of("slice long, bits binary", [now], [np.packbits(total >= least).tobytes()])

        for batch in batches:
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if s != now:
                    if now is not None:
                        yield done()
                    now, total = s, np.zeros(SLICE, np.uint64)
                total += np.frombuffer(unpack.decompress(raw.as_py()), "<u2")
        if now is not None:
            yield done()

    sent_rows = runs.mapInArrow(count, schema).repartition("slice").sortWithinPartitions("slice")
    return _assembled(sent_rows.mapInArrow(add, "slice long, bits binary"), bits)


def candidates(runs: DataFrame, n: int, frequent: np.ndarray, filled: np.ndarray, bits: int) -> DataFrame:
    """hash, k1 .. kn of the phrases of n words that may be frequent."""
    sc = runs.sparkSession.sparkContext
    known, cells = sc.broadcast(frequent), sc.broadcast(filled)
    schema = ", ".join(["hash long", *(f"k{d + 1} long" for d in range(n))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        held, size = [], 0

        def send() -> pa.RecordBatch:
            hashes, *words = (np.concatenate(c) for c in zip(*held))
            found, first = np.unique(hashes, return_index=True)
            return batch_of(schema, found.view(np.int64), *(w[first].view(np.int64) for w in words))

        for keys in runs_of(batches):
            at, hashes = safe_windows(keys, n, known.value, bits)
            some = marked(cells.value, hash_cells(hashes, bits))
            found, first = np.unique(hashes[some], return_index=True)
            at = at[some][first]
            held.append((found, *(keys[at + d] for d in range(n))))
            size += len(found)
            if size > HELD:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    rows = runs.mapInArrow(run, schema).groupBy("hash").agg(*[F.min(f"k{d + 1}").alias(f"k{d + 1}") for d in range(n)])
    return settled(rows, "candidates")


def count_by_tries(runs: DataFrame, found: DataFrame, n: int, most: int = TRIE) -> DataFrame:
    """hash, f: how often each candidate of n words occurs in the runs."""
    groups = max(1, -(-found.count() // most))
    spark, out = runs.sparkSession, None
    dealt = found.withColumn("group", F.pmod(F.xxhash64("hash"), F.lit(groups)))
    for g in range(groups):
        own = dealt.filter(F.col("group") == g).select("hash", *[f"k{d + 1}" for d in range(n)]).toArrow()
        columns = [own.column(i).to_numpy().view(U) for i in range(n + 1)]
        if not len(columns[0]):
            continue
        vocabulary = np.unique(np.concatenate(columns[1:]))
        trie = double_array.build(np.stack([np.searchsorted(vocabulary, c) for c in columns[1:]], 1))
        sent = spark.sparkContext.broadcast((vocabulary, trie, columns[0]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tokens.release()
            vocabulary, trie, hashes = sent.value
            total = np.zeros(len(hashes), np.int64)
            for keys in runs_of(batches):
                number = np.searchsorted(vocabulary, keys)
                number[vocabulary[np.minimum(number, len(vocabulary) - 1)] != keys] = -1
                number = np.concatenate([number, np.full(n, -1)])
                at = np.flatnonzero(number >= 0)
                state = np.full(len(at), double_array.ROOT, np.int64)
                for d in range(n):  # all positions by one more word
                    on = np.flatnonzero(number[at + d] >= 0)
                    at, state = at[on], state[on]
                    stays, state = trie.step(state, number[at + d])
                    at = at[stays]
                total += np.bincount(trie.value[state], minlength=len(hashes))
            some = np.flatnonzero(total)
            yield batch_of("hash long, f long", hashes[some].view(np.int64), total[some])

        # a candidate is in one trie only, so these counts are whole; the trie leaves the machines before the next one comes
        part = settled(runs.mapInArrow(run, "hash long, f long").groupBy("hash").agg(F.sum("f").alias("f")), "trie-counts")
        sent.destroy()
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "hash long, f long") if out is None else out


def frequent_phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Word counts (lang, a hash, key, n), and all frequent phrases: n, hash, f, k1 .. k4 (the words' keys, null beyond n)."""
    counts = word_counts(docs)
    bits = min(MOST_BITS, max(16, ((counts.agg(F.sum("n")).first()[0] or 0) // 16).bit_length()))
    every = [F.col(f"k{d + 1}") for d in range(LONGEST)]
    level = counts.filter(F.col("n") >= least).select(F.col("key").alias("hash"), F.col("n").alias("f"), F.col("key").alias("k1"))
    level = settled(level, "frequent")
    out = level.select(F.lit(1).alias("n"), "hash", "f", "k1", *[F.lit(None).cast("long").alias(f"k{d}") for d in range(2, LONGEST + 1)])
    marks = cell_marks(level, bits)
    runs = key_runs(docs, marks, bits)
    for n in range(2, LONGEST + 1):
        found = candidates(runs, n, marks, sketch(runs, n, least, marks, bits), bits)
        level = count_by_tries(runs, found, n).filter(F.col("f") >= least).join(found, "hash")
        level = settled(level, "frequent")
        out = out.unionByName(level.select(
            F.lit(n).alias("n"), "hash", "f", *(F.col(f"k{d}") if d <= n else F.lit(None).cast("long").alias(f"k{d}") for d in range(1, LONGEST + 1))))
        marks = cell_marks(level, bits)
    return counts, out.select("n", "hash", "f", *every)


def _parts(phrases: DataFrame, inner: bool) -> DataFrame:
    """The inner phrases of phrases of three words and more (hash, above: the count of the whole), or the cuts of phrases of two words and
    more (hash, a, k, left, right)."""
    schema = "hash long, above long" if inner else "hash long, a long, k int, left long, right long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(0).to_numpy()
            for n in range(2, LONGEST + 1):
                own = np.flatnonzero(size == n)
                if not len(own):
                    continue
                whole, f = (batch.column(c).to_numpy()[own] for c in (1, 2))
                keys = np.stack([batch.column(d + 3).fill_null(0).to_numpy()[own].view(U) for d in range(n)], 1)

                def of(a: int, b: int) -> np.ndarray:
                    flat = np.ascontiguousarray(keys[:, a:b]).reshape(-1)
                    return phrase_hashes(flat, b - a)[:: b - a].view(np.int64)

                if inner:
                    for m in range(2, n):
                        for a in range(n - m + 1):
                            yield batch_of(schema, of(a, a + m), f)
                else:
                    for k in range(1, n):
                        yield batch_of(schema, whole, f, np.full(len(own), k), of(0, k), of(k, n))

    return phrases.select("n", "hash", "f", *[f"k{d + 1}" for d in range(LONGEST)]).mapInArrow(run, schema)


def collocations(docs: DataFrame, least: int = 30, closed_percent: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    with passing_tables():
        counts, phrases = frequent_phrases(docs, least)
        sizes = phrases.select("hash", "f")
        whole = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  products may pass 64 bits
        closed = _parts(phrases.filter("n > 2"), inner=True).groupBy("hash").agg(F.max("above").alias("above"))
        open_ = phrases.filter("n > 1").join(closed, "hash", "left")
        open_ = settled(open_.filter(F.col("above").isNull() | (whole("above") * 100 < whole("f") * closed_percent)), "open-phrases")
        halves = _parts(open_, inner=False).join(sizes.select(F.col("hash").alias("left"), F.col("f").alias("l")), "left")
        halves = halves.join(sizes.select(F.col("hash").alias("right"), F.col("f").alias("r")), "right")
        halves = halves.withColumn("score", F.expr("cast(a as decimal(20,0)) * 2000000BD div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
        cut = halves.groupBy("hash", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        rows = cut.select("hash", "a", "cut.score", "cut.l", "cut.r").join(open_.select("hash", *[f"k{d + 1}" for d in range(LONGEST)]), "hash")
        rows = rows.join(counts.filter(F.col("n") >= least).select(F.col("key").alias("k1"), "lang"), "k1")
        near = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
        rows = settled(rows.withColumn("near", F.rank().over(near)).filter(F.col("near") <= top), "best")  # with all ties
        wanted = rows.select(F.explode(F.array(*[f"k{d + 1}" for d in range(LONGEST)])).alias("key")).filter("key is not null").distinct()
        names = words_of(docs, settled(wanted, "wanted"))
        for d in range(1, LONGEST + 1):
            rows = rows.join(names.select(F.col("key").alias(f"k{d}"), F.col("word").alias(f"w{d}")), f"k{d}", "left")
        rows = rows.withColumn("phrase", F.concat_ws(" ", *[f"w{d}" for d in range(1, LONGEST + 1)]))
        last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        rows = rows.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= top)
        totals = settled(counts.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        out = rows.join(totals, "lang").join(language_names(docs), "lang").select(F.col("name").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
        return settled(out, "collocations", stays=True)
