"""Phrases, decontamination and resampling against brute force, on odd rows, repeated rows and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oddsloom.llm import decontaminate, double_array, phrases, resampling
from oddsloom.llm.words import NO_LETTER, find_words

from . import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.table(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return cases.table(spark, [])


def same(rows, want):
    key = lambda t: tuple((x is None, str(x)) for x in t)
    assert sorted((tuple(r) for r in rows), key=key) == sorted(want, key=key)


# --- double array ---


@pytest.mark.parametrize("m,depth,top", [(0, 2, 5), (1, 1, 1), (3000, 2, 200), (5000, 3, 70000), (300, 4, 3)])
def test_double_array(m, depth, top):
    rng = np.random.default_rng(m)
    rows = np.unique(rng.integers(0, top, (m, depth)), axis=0)
    trie = double_array.build(rows)
    asked = np.concatenate([rows, rng.integers(0, top, (500, depth))])
    at, state = np.arange(len(asked)), np.zeros(len(asked), np.int64)
    for d in range(depth):
        stays, state = trie.step(state, asked[at, d])
        at = at[stays]
    found = dict(zip(at.tolist(), trie.value[state].tolist()))
    known = {tuple(r): i for i, r in enumerate(rows.tolist())}
    assert found == {i: known[tuple(r)] for i, r in enumerate(asked.tolist()) if tuple(r) in known}


# --- phrases ---


def brute_phrases(rows, least, closed, top):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            ws = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for m in range(1, 5):
                for i in range(len(ws) - m + 1):
                    f[lang][tuple(ws[i : i + m])] += 1
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            score, k = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            inside = (q for q, b in found.items() if len(q) > len(p) and 100 * b >= closed * a)
            if not any(p == q[i : i + len(p)] for q in inside for i in range(len(q) - len(p) + 1)):
                rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return out


@pytest.mark.parametrize("least,closed,top", [(2, 80, 2000), (4, 50, 7), (10**6, 80, 5)])
def test_phrases(docs, least, closed, top):
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    same(phrases.collocations(docs, least, closed, top).collect(), brute_phrases(rows, least, closed, top))


def test_phrases_dealt_to_several_tries(docs, monkeypatch):
    monkeypatch.setattr(phrases.count_by_tries, "__defaults__", (50,))
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    same(phrases.collocations(docs, 3).collect(), brute_phrases(rows, 3, 80, 2000))


def test_phrases_ties_and_pieces(spark):
    rows = [("x", "b a. b a! B A; c d, c d\nc d\x0bzz\x00 y"), ("x", None), (None, "é b\té b\x85 é b"), ("und", "é b"), ("", "q q q q q q")]
    made = spark.createDataFrame(rows, "lang string, text string")
    same(phrases.collocations(made, 2).collect(), brute_phrases(rows, 2, 80, 2000))


def test_phrases_of_no_rows(empty):
    assert phrases.collocations(empty).collect() == []


# --- decontamination ---


def brute_contaminated(rows, items, window):
    items = [(i, WORD.findall(lower(t))) for i, t in items]
    out = []
    for doc_id, text in rows:
        ws, hit, found = WORD.findall(lower(text)), set(), set()
        for item, own in items:
            size = min(window, len(own))
            for w in range(len(own) - size + 1) if own else ():
                for p in range(len(ws) - size + 1):
                    if ws[p : p + size] == own[w : w + size]:
                        hit |= set(range(p, p + size))
                        found |= {item} - {None}
        names = ",".join(sorted(map(str, found), key=str.encode))
        out.append((doc_id, len(ws), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def items(spark, docs):
    texts = [r.text for r in docs.filter("length(text) > 200").orderBy("doc_id").limit(8).collect()]
    cut = [" ".join(t.split()[4:30]) for t in texts]
    made = [(1, cut[0]), (10, cut[1].upper()), (9, cut[1]), (9, cut[2]), (3, None), (4, ""), (5, "..."), (None, cut[3]), (6, "x x x"), (7, "1234"),
            (8, "not in any text at all " * 3), (11, cut[4] + " unseenword"), (12, "x " * 40)]
    return spark.createDataFrame([(i, t, 1, "w") for i, t in made], "item_id long, text string, row int, word string")


@pytest.mark.parametrize("window,small", [(10, None), (1, None), (3, 0)])
def test_contaminated(docs, items, window, small, monkeypatch):
    if small is not None:  # every table too large to be broadcast
        monkeypatch.setattr(decontaminate, "SMALL", small)
    few = docs.filter("length(text) < 10000 OR text IS NULL")
    rows = [(r.doc_id, r.text) for r in few.select("doc_id", "text").collect()]
    tests = [(r.item_id, r.text) for r in items.collect()]
    same(decontaminate.contaminated(few, items, window).collect(), brute_contaminated(rows, tests, window))


def test_contaminated_long_text(spark):
    text = "a b " * 30000 + "one two three four " + "a c " * 100
    made = spark.createDataFrame([(1, text), (2, "ONE, two; three-four")], "doc_id long, text string")
    tests = spark.createDataFrame([("i", "b one two three four a")], "item_id string, text string")
    rows = {r.doc_id: r for r in decontaminate.contaminated(made, tests, 4).collect()}
    assert (rows[1].n_words, rows[1].n_hit, rows[2].n_hit) == (60204, 6, 4)


def test_contaminated_without_rows(docs, empty, items):
    assert decontaminate.contaminated(empty, items).collect() == []
    rows = decontaminate.contaminated(docs, items.limit(0)).collect()
    assert len(rows) == docs.count() and not any(r.contaminated for r in rows)


def test_proximity(spark):
    made = spark.createDataFrame([(1, "z alpha beta x gamma delta z"), (2, "alpha beta gamma delta"), (3, "alpha beta x y z w gamma delta")], "doc_id long, text string")
    tests = spark.createDataFrame([("i", "alpha beta gamma delta")], "item_id string, text string")
    exact = {(r.doc_id, r.first_word, r.last_word) for r in decontaminate.matches(made, tests, 4).collect()}
    near = {(r.doc_id, r.first_word, r.last_word) for r in decontaminate.matches(made, tests, 4, slop=1).collect()}
    assert exact == {(2, 0, 3)} and near == {(1, 1, 5), (2, 0, 3)}


def test_decontamination_is_native(docs, items):
    plan = decontaminate.contaminated(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- resampling ---


def test_crcs():
    texts = ["a bc", "", None, "é ß 日本", "x" * 300 + " y", "1 2 3 " * 5]
    words = find_words(pa.array(texts), breaks=NO_LETTER)
    own = [bytes(words.data[s:e]) for s, e in zip(words.starts, words.ends)]
    first = resampling.crcs(words)
    assert first.tolist() == [zlib.crc32(w) for w in own]
    second = resampling.crcs(words, np.roll(first, 1))
    assert second.tolist() == [zlib.crc32(own[i - 1] + w) for i, w in enumerate(own)]


def brute_resample(rows, target, grams, buckets, least, percent, seed):
    def features(text):
        ws = WORD.findall(lower(text))
        return len(ws), [" ".join(ws[i : i + g]) for g in range(1, grams + 1) for i in range(len(ws) - g + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    raw = Counter(bucket(f) for _, t in rows for f in features(t)[1])
    aim = Counter(bucket(f) for t in target for f in features(t)[1])
    s_all, t_all = sum(raw.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in rows:
        n, found = features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted(range(len(out)), key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0))
    able = [i for i in able if out[i][4] >= least]
    ranks = {i: r for r, i in enumerate(able[: percent * len(able) // 100], 1)}
    return [(*row[:4], ranks.get(i)) for i, row in enumerate(out)]


@pytest.mark.parametrize("grams,buckets,least,percent", [(2, 10000, 20, 25), (3, 17, 1, 100), (1, 100, 0, 60), (2, 50, 10**6, 50)])
def test_resample(docs, items, grams, buckets, least, percent):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    target = [r.text for r in items.collect()]
    want = brute_resample(rows, target, grams, buckets, least, percent, 7)
    same(resampling.resample(docs, items, grams, buckets, least, percent, 7).collect(), want)


def test_kth_key_with_ties(spark):
    made = spark.range(3000).select(F.pmod("id", F.lit(3)).alias("score"), F.when(F.col("id") % 7 > 0, F.col("id") % 50).alias("doc_id"), F.col("id").alias("row"))
    order = sorted(((-r.score, r.doc_id is None, r.doc_id or 0, r.row) for r in made.collect()))
    for k in (1, 2, 1499, 2999, 3000):
        assert resampling.kth_key(made, k, pivots=4) == order[k - 1]


def test_resample_without_rows(docs, empty, items):
    assert resampling.resample(empty, items).collect() == []
    assert resampling.resample(docs, items.limit(0)).count() == docs.count()


def test_draw_takes_whole_rows(docs, items):
    drawn = resampling.draw(docs, items)
    assert drawn.count() == docs.filter(F.size(decontaminate.words(F.col("text"))) >= 20).count() * 25 // 100
