"""A language model kept as an Elias-Fano trie of n-grams.

Level one is the vocabulary: 64-bit hashes of words in rising order, an Elias-Fano sequence; a word's id is its place
in it. Running counts, a second sequence, give exact counts. Level two holds the words that followed each word: an
Elias-Fano sequence of pointers gives each context's run of successors, and one Elias-Fano sequence holds all runs,
each id relative to its context (it is added to the last value of the run before, plus one), so that a lookup is a
successor search of base + id within the context's run. Each entry has its smoothed probability in one byte.

Smoothing: P(w | u) = (c(u w) + mu P(w)) / (c(u) + mu), with P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). A text is preceded and
followed by an end mark. Log probabilities are rounded down to one of 256 steps between the least of the shard and 0, so a context's
probabilities never sum to more than one.

The levels are cut into shards: level one by ranges of the hash, level two by ranges of (context, word) that hold
about equal numbers of tokens, so the successors of a very frequent word are spread over shards. Counts are combined
in a task before they are dealt out, and each shard is merged and written by one task, as a file in the shared folder
that the scoring tasks map into memory. All texts of the training part are counted; nothing is pruned.

Null text: the end mark alone. Null doc_id: scored, and held out. Repeated rows count and are scored each. No
training text: every token is unknown. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .elias_fano import EliasFano, open_arrays, write_arrays
from .storage import folder, settled
from .words import find_words, mix, word_hashes

U = np.uint64
END = mix(np.array([0x9D2C5680E4F1A7B3], U))[0]  # the hash of the end mark
FLUSH = 3_000_000  # n-grams that a task holds before it sends them
ROUND = 1 << 21  # tokens counted or scored at a time
MU = 32.0
_open: dict[str, Model] = {}


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a batch, every text followed by the end mark, and where each text begins."""
    words = find_words(column)
    ends = words.first[1:]
    hashes = np.insert(word_hashes(words), ends, END)
    return hashes, words.first + np.arange(len(words.first))


def slices(column: pa.Array, size: int = 4 * ROUND) -> Iterator[pa.Array]:
    """Rows of a batch in runs of about ``size`` bytes, those of ``ROUND`` tokens."""
    sizes = np.cumsum(np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]))
    at = 0
    while at < len(column):
        start = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, start + size)))
        yield column.slice(at, to - at)
        at = to


def _sent(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising keys and their counts, byte planes compressed."""
    planes = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8).T
    few = np.minimum(counts, 255).astype(np.uint8)
    big = counts[counts >= 255].astype("<u4")
    raw = len(keys).to_bytes(8, "little") + planes.tobytes() + few.tobytes() + big.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _received(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int.from_bytes(raw[:8], "little")
    keys = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T).view(U).reshape(-1)
    counts = np.frombuffer(raw, np.uint8, n, 8 + 8 * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<u4", -1, 8 + 9 * n)
    return keys, counts


def _add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _counted(docs: DataFrame, shards: int, keys_of, shard_of, write, schema: str) -> list:
    """Count keys of all texts, deal them to shards, write each shard with ``write(shard, keys, counts)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            keys, counts = _add_up(held)
            cuts = np.searchsorted(shard_of(keys), np.arange(shards + 1))
            own = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
            packed = [_sent(keys[cuts[s] : cuts[s + 1]], counts[cuts[s] : cuts[s + 1]]) for s in own]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(packed, pa.binary())], ["shard", "counts"])

        for batch in batches:
            for column in slices(batch.column(0)):
                keys, n = np.unique(keys_of(column), return_counts=True)
                held.append((keys, n))
                size += len(keys)
                if size > FLUSH:
                    yield send()
                    held, size = [], 0
        if size:
            yield send()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
        columns = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

        def done() -> pa.RecordBatch:
            row = write(now, *_add_up(parts))
            return pa.RecordBatch.from_pylist([dict(zip(columns.names, row))], schema=columns)

        for batch in batches:
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if s != now:
                    if parts:
                        yield done()
                    now, parts = s, []
                parts.append(_received(raw.as_py()))
                if len(parts) >= 16:
                    parts = [_add_up(parts)]
        if parts:
            yield done()

    sent = docs.mapInArrow(count, "shard int, counts binary").repartition("shard").sortWithinPartitions("shard")
    return settled(sent.mapInArrow(merge, schema), "trie-level").orderBy("shard").collect()  # a row per shard


class Model:
    """The levels of a trie, opened by a task."""

    def __init__(self, plan: dict):
        self.plan, self.mu = plan, plan["mu"]
        self.bits, self.n, self.v = plan["bits"], plan["n"], plan["v"]
        files = [open_arrays(f"{plan['path']}/{x}") for x in plan["words"]]
        self.words = [(EliasFano.of(f, "hash"), EliasFano.of(f, "count")) for f in files]
        self.word_slices = np.array(plan["word_slices"], np.int64)
        self.word_start = np.array(plan["word_start"], np.int64)  # ids before each file
        self.token_start = np.array(plan["token_start"], np.int64)  # tokens before each file
        self.pairs = {s: open_arrays(f"{plan['path']}/{x}") for s, x in zip(plan.get("pair_shards", []), plan.get("pairs", []))}

    @classmethod
    def open(cls, plan: dict) -> Model:
        key = f"{plan['path']}:{len(plan.get('pairs', []))}"
        if key not in _open:
            _open.clear()
            _open[key] = cls(plan)
        return _open[key]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, counts, tokens of smaller ids) of distinct rising hashes; id -1 and count 0 where unknown."""
        ids, counts, before = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        cut = (hashes >> U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        mask = U((1 << (64 - self.bits)) - 1)
        for k, s in enumerate(self.word_slices):
            a, b = np.searchsorted(cut, [s, s + 1])
            if a == b:
                continue
            words, running = self.words[k]
            at = words.index(hashes[a:b] & mask)
            known = at >= 0
            i = at[known]
            upto = running.access(i).astype(np.int64)
            under = np.where(i > 0, running.access(np.maximum(i - 1, 0)).astype(np.int64), 0)
            part = np.flatnonzero(known) + a
            ids[part], counts[part], before[part] = i + self.word_start[k], upto - under, under + self.token_start[k]
        return ids, counts, before

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def pair_scores(self, u: np.ndarray, w: np.ndarray, shard: np.ndarray, unseen: np.ndarray) -> np.ndarray:
        """log10 P(w | u) of pairs sorted by (u, w); ``unseen`` is their value where the trie lacks them."""
        out = unseen.copy()
        cuts = np.searchsorted(shard, np.arange(self.plan["shards"] + 1))
        for s, file in self.pairs.items():
            a, b = cuts[s], cuts[s + 1]
            if a == b:
                continue
            at = find_pairs(file, u[a:b], w[a:b])
            hit = at >= 0
            low, step = file["low"], file["step"]
            out[a:b][hit] = low + step * file["prob"][at[hit]]
        return out


def find_pairs(file: dict, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of pairs, sorted by u, in a shard of level two; -1 where it lacks them."""
    pointers, runs = EliasFano.of(file, "pointer"), EliasFano.of(file, "run")
    found = np.full(len(u), -1, np.int64)
    inside = np.flatnonzero((u >= file["first"]) & (u <= file["last"]))
    if not len(inside):
        return found
    u, w = u[inside], w[inside]
    context, which = np.unique(u, return_inverse=True)
    start = pointers.access(context - file["first"]).astype(np.int64)
    end = pointers.access(context - file["first"] + 1).astype(np.int64)
    base = np.zeros(len(context), U)
    later = start > 0
    base[later] = runs.access(start[later] - 1) + U(1)
    some = (end > start)[which]
    place = runs.index(base[which[some]] + w[some].astype(U))
    own = (place >= start[which[some]]) & (place < end[which[some]])  # else it belongs to a later run
    place[~own] = -1
    found[inside[some]] = place
    return found


def _shard(before: np.ndarray, counts: np.ndarray, w: np.ndarray, plan: dict) -> np.ndarray:
    """The shard of each (u, w): u's tokens are spread over its range in the order of w."""
    token = before + (w.astype(np.float64) / plan["v"] * counts).astype(np.int64)
    return np.minimum(token.astype(np.float64) / plan["n"] * plan["shards"], plan["shards"] - 1).astype(np.int64)


def _ids(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """ids, counts, tokens before, for every token."""
    distinct, which = np.unique(hashes, return_inverse=True)
    ids, counts, before = model.look_up(distinct)
    return ids[which], counts[which], before[which]


def learn(docs: DataFrame, mu: float = MU) -> dict:
    """The plan of a trie that counts all of ``docs`` (text): names of its files and a few numbers."""
    spark = docs.sparkSession
    path = folder(spark, "trie")
    texts = docs.select(F.col("text").cast("string"))
    shards = 1 << max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    bits = shards.bit_length() - 1

    def write_words(s: int, keys: np.ndarray, counts: np.ndarray) -> tuple:
        name = f"words-{s:05d}-{uuid.uuid4().hex}"
        total = int(counts.sum())
        hashes = EliasFano.build(keys & U((1 << (64 - bits)) - 1), 1 << (64 - bits))
        running = EliasFano.build(np.cumsum(counts).astype(U), total + 1)
        write_arrays(f"{path}/{name}", hashes.arrays("hash") | running.arrays("count"), {"hash": [hashes.n, hashes.width], "count": [running.n, running.width]})
        return s, name, len(keys), total

    level = _counted(texts, shards, lambda c: tokens(c)[0], lambda k: (k >> U(64 - bits)).astype(np.int64), write_words, "shard int, file string, words long, tokens long")
    words, totals = np.array([r["words"] for r in level], np.int64), np.array([r["tokens"] for r in level], np.int64)
    plan = {"path": path, "mu": mu, "bits": bits, "shards": shards, "n": int(totals.sum()), "v": int(words.sum()),
            "words": [r["file"] for r in level], "word_slices": [r["shard"] for r in level],
            "word_start": (np.cumsum(words) - words).tolist(), "token_start": (np.cumsum(totals) - totals).tolist()}
    if plan["v"] >= 1 << 32:
        raise ValueError("a vocabulary of 2 ** 32 words or more")
    if not plan["n"]:
        return plan | {"pairs": [], "pair_shards": []}

    def pair_keys(column: pa.Array) -> np.ndarray:
        model = Model.open(plan)
        hashes, first = tokens(column)
        ids = _ids(model, hashes)[0].astype(U)
        before = np.concatenate([[U(0)], ids[:-1]])
        before[first[:-1]] = _ids(model, np.array([END]))[0].astype(U)
        return before << U(32) | ids

    def of_keys(keys: np.ndarray) -> np.ndarray:
        model = Model.open(plan)
        u, w = (keys >> U(32)).astype(np.int64), (keys & U(0xFFFFFFFF)).astype(np.int64)
        distinct, which = np.unique(u, return_inverse=True)
        counts, before = id_counts(model, distinct)
        return _shard(before[which], counts[which], w, plan)

    def write_pairs(s: int, keys: np.ndarray, counts: np.ndarray) -> tuple:
        model = Model.open(plan)
        u, w = (keys >> U(32)).astype(np.int64), (keys & U(0xFFFFFFFF)).astype(np.int64)
        first, last = int(u[0]), int(u[-1])
        context, start = np.unique(u, return_index=True)
        end = np.append(start[1:], len(u))
        pointer = np.searchsorted(u, np.arange(first, last + 2)).astype(U)
        step = w[end - 1].astype(U) + U(1)  # a run's last id, plus one, moves the next run
        base = np.cumsum(step) - step
        run = np.repeat(base, end - start) + w.astype(U)
        pointers = EliasFano.build(pointer, len(u) + 1)
        runs = EliasFano.build(run, int(step.sum()) + 1)
        n_u = np.repeat(id_counts(model, context)[0], end - start)
        distinct, which = np.unique(w, return_inverse=True)
        p_w = 10 ** model.base(id_counts(model, distinct)[0])[which]
        value = np.log10((counts + mu * p_w) / (n_u + mu))
        low = float(value.min()) - 1e-9
        grain = -low / 255
        prob = np.floor((value - low) / grain).astype(np.uint8)
        name = f"pairs-{s:05d}-{uuid.uuid4().hex}"
        write_arrays(f"{path}/{name}", pointers.arrays("pointer") | runs.arrays("run") | {"prob": prob},
                     {"pointer": [pointers.n, pointers.width], "run": [runs.n, runs.width], "first": first, "last": last, "low": low, "step": grain})
        return s, name, len(keys)

    level = _counted(texts, shards, pair_keys, of_keys, write_pairs, "shard int, file string, pairs long")
    return plan | {"pairs": [r["file"] for r in level], "pair_shards": [r["shard"] for r in level]}


def id_counts(model: Model, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, tokens of smaller ids) of known rising ids."""
    counts, before = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    cuts = np.searchsorted(ids, np.append(model.word_start, np.iinfo(np.int64).max))
    for k in range(len(model.words)):
        a, b = cuts[k], cuts[k + 1]
        if a < b:
            i = ids[a:b] - model.word_start[k]
            running = model.words[k][1]
            upto = running.access(i).astype(np.int64)
            under = np.where(i > 0, running.access(np.maximum(i - 1, 0)).astype(np.int64), 0)
            counts[a:b], before[a:b] = upto - under, under + model.token_start[k]
    return counts, before


def _scored(model: Model, column: pa.Array) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base score and score of each text."""
    hashes, first = tokens(column)
    n = np.diff(first)
    ids, counts, before = _ids(model, hashes)
    base = model.base(counts)
    start = first[:-1]
    u, n_u, under = (np.concatenate([x[:1], x[:-1]]) for x in (ids, counts, before))
    end = _ids(model, np.array([END]))
    for x, y in zip((u, n_u, under), end):
        x[start] = y
    unseen = np.where(u >= 0, np.log10(model.mu / (n_u + model.mu)), 0.0) + base
    score = unseen.copy()
    both = np.flatnonzero((u >= 0) & (ids >= 0))
    if len(both) and model.pairs:
        key = u[both].astype(U) << U(32) | ids[both].astype(U)
        pairs, at, which = np.unique(key, return_index=True, return_inverse=True)
        token = both[at]
        shard = _shard(under[token], n_u[token], ids[token], model.plan)
        score[both] = model.pair_scores(u[token], ids[token], shard, unseen[token])[which]
    return n, np.add.reduceat(counts > 0, start, dtype=np.int64), np.add.reduceat(base, start), np.add.reduceat(score, start)


def held_out(doc_id: str = "doc_id", parts: int = 10, part: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts, F.lit(part)) == part


def score(docs: DataFrame, plan: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.open(plan)
        for batch in batches:
            at = 0
            for column in slices(batch.column(1)):
                n, known, base, own = _scored(model, column)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(column)), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                     pa.array(np.full(len(n), model.n), pa.int64()), pa.array(base), pa.array(own)],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                at += len(column)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def learn_and_score(docs: DataFrame, mu: float = MU) -> DataFrame:
    """Learn from the documents that aren't held out, score all of them."""
    plan = learn(docs.filter(~held_out()), mu)
    return score(docs, plan).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
