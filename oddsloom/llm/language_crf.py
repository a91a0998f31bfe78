"""Language identification by a linear-chain conditional random field over words.

Each word has a label. Its features are affixes (first and last bytes, two to four), the byte trigrams around each of
its bytes, and whether a lexicon of one language holds it; labels of neighbours are tied by learned transitions.
Forward-backward over a whole text gives every word's label probabilities, so text that switches language is
labelled word by word; a document's language is the label with the largest sum, its score the share of that sum.

Learning: at most ``sample_docs`` documents of each language (those with the smallest hash of doc_id among the rows given) are brought to
the driver. Their texts are cut into runs of 8 to 40 words, and the runs are shuffled into training sequences, so that the
transitions see changes of language. Weights, lexicon and transitions are the model, a few MB that are broadcast.
Prediction is one pass over whole texts without a shuffle, vectorised over the texts of a batch.

Null text, or one without a letter: ``und`` with score 0. Null lang: not learned from. Null doc_id: predicted, held
out. No labelled row: ``und`` for all. Repeated rows: each predicted. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import BASE, find_words, word_hashes

U = np.uint64
TABLE = 1 << 16
KINDS = ("first2", "first3", "first4", "last2", "last3", "last4")
LETTER = re.compile(r"[^\W\d_]")
BYTES = 1 << 21  # of text worked on at a time
SEQUENCE, TOGETHER = 64, 64


class Features(NamedTuple):
    """Feature numbers of the words of a batch."""

    trigram: np.ndarray  # one for each byte of a word
    begin: np.ndarray  # where a word's trigrams begin
    affix: np.ndarray  # (kinds, words)
    lexicon: np.ndarray  # the label whose lexicon holds the word, or the number of labels
    first: np.ndarray  # where a text's words begin


class Model(NamedTuple):
    labels: list[str]
    trigram: np.ndarray
    affix: np.ndarray
    lexicon: np.ndarray
    transition: np.ndarray
    words: np.ndarray  # hashes of the lexicon, rising
    word_label: np.ndarray


def _bucket(code: np.ndarray, salt: int) -> np.ndarray:
    return ((code + U(salt)) * BASE >> U(48)).astype(np.int32)


def features(column: pa.Array, words: np.ndarray, word_label: np.ndarray, n_labels: int) -> Features:
    found = find_words(column)
    size = found.ends - found.starts
    n = len(size)
    begin = np.cumsum(size) - size
    # each word between two spaces
    place = np.arange(size.sum()) + np.repeat(np.arange(1, n + 1), size)
    text = np.full(len(place) + n + 5, 32, np.uint8)
    text[place] = found.data[np.repeat(found.starts - begin, size) + np.arange(size.sum())]
    wide = text.astype(np.uint32)
    code = (wide[place - 1] << 16 | wide[place] << 8 | wide[place + 1]).astype(U)
    start = begin + np.arange(1, n + 1)
    end = start + size
    affix = np.empty((len(KINDS), n), np.int32)
    for k, length in enumerate((2, 3, 4)):
        head, tail = np.zeros(n, U), np.zeros(n, U)
        for j in range(length):
            head = head << U(8) | np.where(j < size, text[np.minimum(start + j, end - 1)], 32).astype(U)
            tail = tail << U(8) | np.where(j < size, text[np.maximum(end - 1 - j, start)], 32).astype(U)
        affix[k], affix[k + 3] = _bucket(head, 7 * k + 1), _bucket(tail, 7 * k + 4)
    lexicon = np.full(n, n_labels, np.int32)
    if len(words) and n:
        hashes = word_hashes(found)
        at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
        hit = words[at] == hashes
        lexicon[hit] = word_label[at[hit]]
    return Features(_bucket(code, 3), begin, affix, lexicon, found.first)


def emissions(f: Features, m: Model) -> np.ndarray:
    if not len(f.begin):
        return np.zeros((0, len(m.labels)), np.float32)
    out = np.add.reduceat(m.trigram[f.trigram], f.begin, axis=0)
    for k in range(len(KINDS)):
        out += m.affix[k][f.affix[k]]
    return out + m.lexicon[f.lexicon]


def posteriors(e: np.ndarray, transition: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Label probabilities of all words by forward-backward; texts advance together, one word a step."""
    e = np.exp(e - e.max(axis=1, keepdims=True)) if len(e) else e
    step = np.exp(transition - transition.max())
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")  # texts longer than t
    alpha = np.empty_like(e)
    now = None
    for t in range(longest):
        at = start[: active[t]] + t
        now = e[at] if now is None else (now[: len(at)] @ step) * e[at]
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
    beta = None
    for t in range(longest - 1, -1, -1):
        at = start[: active[t]] + t
        more = np.ones((len(at), e.shape[1]), e.dtype)
        if beta is not None:
            more[: len(beta)] = beta
        both = alpha[at] * more
        alpha[at] = both / both.sum(axis=1, keepdims=True)
        beta = (e[at] * more) @ step.T
        beta /= beta.sum(axis=1, keepdims=True)
    return alpha


def lexicon(rows: list[tuple[str, int]], n_labels: int, least: int = 2, share: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """Words seen ``least`` times or more with ``share`` of them under one label."""
    hashes, labels = [], []
    for text, label in rows:
        found = word_hashes(find_words(pa.array([text])))
        hashes.append(found)
        labels.append(np.full(len(found), label))
    words, which = np.unique(np.concatenate(hashes), return_inverse=True)
    count = np.zeros((len(words), n_labels), np.int64)
    np.add.at(count, (which, np.concatenate(labels)), 1)
    total = count.sum(axis=1)
    keep = (total >= least) & (count.max(axis=1) >= share * total)
    return words[keep], count.argmax(axis=1)[keep].astype(np.int32)


def fit(rows: list[tuple[str, str]], epochs: int = 3, rate: float = 0.3, seed: int = 7) -> Model:
    """The model of (text, label) rows."""
    labels = sorted({label for _, label in rows})
    n_labels, number = len(labels), {label: i for i, label in enumerate(labels)}
    rng = np.random.default_rng(seed)
    known = [(text, number[label]) for text, label in rows]
    words, word_label = lexicon(known, n_labels) if known else (np.zeros(0, U), np.zeros(0, np.int32))
    m = Model(labels, np.zeros((TABLE, n_labels), np.float32), np.zeros((len(KINDS), TABLE, n_labels), np.float32),
              np.zeros((n_labels + 1, n_labels), np.float32), np.zeros((n_labels, n_labels)), words, word_label)
    if n_labels < 2:
        return m
    runs = []
    for text, label in known:
        pieces, at = text.split(), 0
        while at < len(pieces):
            to = at + int(rng.integers(8, 41))
            runs.append((" ".join(pieces[at:to]), label))
            at = to
    rng.shuffle(runs)
    f = features(pa.array([r for r, _ in runs], pa.large_string()), words, word_label, n_labels)
    truth = np.repeat([label for _, label in runs], np.diff(f.first))
    n = len(truth)
    whole = max(1, n // SEQUENCE)
    ends = np.append(f.begin[1:], len(f.trigram))
    squares = [np.full(a.shape, 1e-2, a.dtype) for a in (m.trigram, m.affix, m.lexicon, m.transition)]
    for _ in range(epochs):
        turn = rng.permutation(whole)
        for at in range(0, whole, TOGETHER):
            own = (turn[at : at + TOGETHER, None] * SEQUENCE + np.arange(min(SEQUENCE, n))).reshape(-1)
            first = np.arange(0, len(own) + 1, min(SEQUENCE, n))
            size = ends[own] - f.begin[own]
            begin = np.cumsum(size) - size
            trigram = f.trigram[np.repeat(f.begin[own] - begin, size) + np.arange(size.sum())]
            part = Features(trigram, begin, f.affix[:, own], f.lexicon[own], first)
            e = emissions(part, m).astype(np.float64)
            label = truth[own]
            slope, pull = gradient(e, m.transition, first, label)
            slope /= len(first) - 1
            pull /= len(first) - 1
            each = np.repeat(np.arange(len(own)), size)
            _learn(m.trigram, squares[0], trigram, slope[each], rate)
            for k in range(len(KINDS)):
                _learn(m.affix[k], squares[1][k], part.affix[k], slope, rate)
            _learn(m.lexicon, squares[2], part.lexicon, slope, rate)
            squares[3] += pull**2
            m.transition[...] += rate * pull / np.sqrt(squares[3])
    return m


def _learn(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, slope: np.ndarray, rate: float) -> None:
    """A step of each touched row along its summed slope, shortened by the steps before."""
    touched, which = np.unique(rows, return_inverse=True)
    total = np.stack([np.bincount(which, slope[:, j], len(touched)) for j in range(slope.shape[1])], axis=1)
    squares[touched] += total**2
    table[touched] += rate * total / np.sqrt(squares[touched])


def gradient(e: np.ndarray, transition: np.ndarray, first: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the log probability of ``label`` with respect to emissions and transitions; texts of one length."""
    n_labels = e.shape[1]
    length = int(first[1] - first[0])
    ex = np.exp(e - e.max(axis=1, keepdims=True)).reshape(-1, length, n_labels)
    step = np.exp(transition - transition.max())
    alpha, beta = np.empty_like(ex), np.ones_like(ex)
    for t in range(length):
        now = ex[:, t] if t == 0 else (alpha[:, t - 1] @ step) * ex[:, t]
        alpha[:, t] = now / now.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        now = (ex[:, t + 1] * beta[:, t + 1]) @ step.T
        beta[:, t] = now / now.sum(axis=1, keepdims=True)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    pair = alpha[:, :-1, :, None] * step * (ex[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    truth = np.eye(n_labels)[label].reshape(-1, length, n_labels)
    seen = np.einsum("btl,btm->lm", truth[:, :-1], truth[:, 1:])
    return (truth - post).reshape(-1, n_labels), seen - pair.sum(axis=(0, 1))


def learn(docs: DataFrame, sample_docs: int = 200) -> Model:
    """Fit on at most ``sample_docs`` rows of each lang of ``docs`` (doc_id, text, lang)."""
    rows = docs.filter("lang is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    chance = F.xxhash64(F.lit("sample"), "doc_id")
    ranked = rows.select("doc_id", "lang", F.row_number().over(Window.partitionBy("lang").orderBy(chance, "doc_id")).alias("n"))
    chosen = ranked.filter(F.col("n") <= sample_docs).select("doc_id", "lang").distinct()
    # sample_docs rows a language
    found = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").orderBy("lang", "doc_id", F.xxhash64("text")).collect()
    return fit([(r["text"], r["lang"]) for r in found])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for batch in batches:
            for at, column in pieces_of(batch.column(1)):
                labels, scores = label_texts(column, m)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(column)), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def pieces_of(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows with about ``BYTES`` of text."""
    upto = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + BYTES)) - 1)
        yield at, column.slice(at, to - at)
        at = to


def word_labels(column: pa.Array, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities of every word's labels, where each text's words begin)."""
    f = features(column, m.words, m.word_label, len(m.labels))
    return posteriors(emissions(f, m).astype(np.float64), m.transition, f.first), f.first


def label_texts(column: pa.Array, m: Model) -> tuple[list[str], list[float]]:
    if not m.labels:
        return ["und"] * len(column), [0.0] * len(column)
    post, first = word_labels(column, m)
    total = np.zeros((len(column), len(m.labels)))
    some = np.flatnonzero(np.diff(first))
    if len(some):
        total[some] = np.add.reduceat(post, first[:-1][some], axis=0)
    best = total.argmax(axis=1)
    share = total.max(axis=1) / np.maximum(np.diff(first), 1)
    letters = [bool(t and LETTER.search(t)) for t in column.to_pylist()]
    return ([m.labels[b] if ok else "und" for b, ok in zip(best, letters)],
            [float(min(1.0, s)) if ok else 0.0 for s, ok in zip(share, letters)])


def learn_and_predict(docs: DataFrame, sample_docs: int = 200) -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod 4 is not 2, predict all."""
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(2)) == 2
    model = learn(docs.filter(~part), sample_docs)
    return predict(docs, model).select("doc_id", part.alias("held_out"), "lang_pred", "score")
