"""The dealt operators against brute force, on odd rows, repeated rows and empty tables."""

import hashlib
import io
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oddsloom.llm import (
    bitplanes, exact_dedup, fuzzy_lines, jaccard_join, language_crf, mixing, ngram_trie, packing, quality, warc,
)
from oddsloom.llm.components import components
from oddsloom.llm.elias_fano import EliasFano
from oddsloom.llm.tokens import Encoder, default_vocabulary
from oddsloom.llm.words import find_words, word_hashes

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.table(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return cases.table(spark, [])


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_vocabulary())


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# --- encoder, words, sequences ---


def test_encoder_equals_library(tokenizer):
    encoder = Encoder(default_vocabulary(), kept=50)
    texts = [t or "" for t in cases.texts(__import__("random").Random(1))] + [
        " ", "\n", "a \nb", "a  b", "\ta b", "a\n\nb", "x's don't", "a\r\nb", "a b c", "...\n\n...", "ª ² ⅷ", "\n a"]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want
    assert encoder.encode(texts[::-1]) == want[::-1]


def test_words_are_exact():
    texts = ["A b\x0bc", None, "", "  x ", "é\x85y z", "a" * 5000, "tail"]
    found = find_words(pa.array(texts))
    want = [[w.encode() for w in WORD.findall((t or ""))] for t in texts]
    for i, words in enumerate(want):
        own = [bytes(found.data[s:e]) for s, e in zip(found.starts, found.ends)][found.first[i] : found.first[i + 1]]
        assert own == [w.lower() if w.isascii() else w for w in words]
    hashes = word_hashes(found)
    assert len(set(hashes.tolist())) == len({bytes(found.data[s:e]) for s, e in zip(found.starts, found.ends)})


@pytest.mark.parametrize("n,bound", [(1, 5), (1000, 1 << 20), (3000, 1 << 50), (500, 500), (3, 1 << 63)])
def test_elias_fano(n, bound):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, bound, n).astype(np.uint64))
    sequence = EliasFano.build(values, bound)
    assert (sequence.access(np.arange(n)) == values).all()
    asked = np.concatenate([values, rng.integers(0, bound, n).astype(np.uint64)])
    assert (sequence.find(asked) == np.searchsorted(values, asked)).all()
    assert ((sequence.index(asked) >= 0) == np.isin(asked, values)).all()


# --- packing ---


@pytest.mark.parametrize("context", [1, 8, 1024])
def test_packing(docs, tokenizer, context):
    pieces = packing.pack(docs, context=context).collect()
    want = Counter()
    for doc_id, text in texts_of(docs):
        ids, start = ids_of(tokenizer, text), 0
        for length in packing.binary_lengths(len(ids), context):
            want[(doc_id, start, length, len(ids), ids[start : start + length].tobytes())] += 1
            start += length
        assert start == len(ids)
    assert Counter((p.doc_id, p.start, p.length, p.doc_tokens, bytes(p.ids)) for p in pieces) == want
    assert all(p.length & (p.length - 1) == 0 and 1 << p.bucket == p.length <= context and p.offset == 0 for p in pieces)
    assert len({p.sequence_id for p in pieces}) == len(pieces)


def test_packing_of_nothing(empty):
    assert packing.pack(empty).count() == 0


# --- language model ---


def test_trie_scores(docs):
    found = ngram_trie.learn_and_score(docs, mu=4.0).collect()
    rows = [(d, [w.lower() if w.isascii() else w for w in (t or "").encode().lower().split()] + ["end"]) for d, t in texts_of(docs)]
    train = [t for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 10]
    one, two = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["end"] + t, t))
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    assert len(found) == len(rows)
    want = defaultdict(list)
    for d, t in rows:
        base = sum(math.log10(p(w)) for w in t)
        own = sum(math.log10((two[u, w] + 4 * p(w)) / (one[u] + 4)) if one[u] else math.log10(p(w)) for u, w in zip(["end"] + t, t))
        want[d].append((len(t), sum(one[w] > 0 for w in t), base, own))
    got = defaultdict(list)
    for r in found:
        assert r.train_tokens == n and r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        got[r.doc_id].append((r.n_tokens, r.n_known, r.base_score, r.score))
    for d in want:
        for x, y in zip(sorted(want[d]), sorted(got[d]), strict=True):
            assert x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-6 * x[0] + 1e-9
            assert x[3] - 0.05 * x[0] < y[3] <= x[3] + 1e-6  # rounded down


def test_trie_of_nothing(empty, docs):
    assert ngram_trie.learn_and_score(empty).count() == 0
    plan = ngram_trie.learn(empty)
    row = ngram_trie.score(docs.limit(1), plan).first()
    assert row.n_known == 0 and row.score == pytest.approx(row.base_score)


# --- Jaccard join ---


def brute_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return Counter((d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("k,percent", [(4, 85), (2, 50)])
def test_jaccard_join(docs, k, percent):
    found = jaccard_join.linked_components(docs, k, percent, sketch_bits=16).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(texts_of(docs), k, percent)


def test_jaccard_join_without_doc_id(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(words)), (None, " ".join([*words, "x"])), (5, " ".join([*words, "y"])), (6, " ".join([*words, "y"])), (None, " ".join([*words, "y"]))]
    found = jaccard_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, sketch_bits=16).collect()
    assert Counter((r.doc_id, r.component_id) for r in found) == Counter({(None, 5): 3, (5, 5): 1, (6, 5): 1})


def test_jaccard_join_bridge_without_doc_id(spark):
    """Two documents that link only through one without a doc_id, and two without a doc_id that link with nothing else."""
    words = [f"w{i}" for i in range(300)]
    rows = [(9, words[:200]), (None, words[12:212]), (4, words[24:224]), (None, words[230:290]), (None, [*words[230:290], "x"])]
    rows = [(d, " ".join(w)) for d, w in rows]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = jaccard_join.linked_components(made, 4, 85, sketch_bits=16).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows, 4, 85)
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == {9: 4, 4: 4}
    kept = jaccard_join.keep_one(made, 4, 85, sketch_bits=16).collect()
    assert sorted((r.doc_id or -1, r.text[:4]) for r in kept) == [(-1, "w230"), (4, "w24 ")]


def test_jaccard_join_chain_and_clique(spark):
    """A chain of texts that each link with the next alone, and near copies of one text."""
    words = [f"w{i}" for i in range(400)]
    chain = [" ".join(words[i * 6 : i * 6 + 200]) for i in range(12)]
    clique = [" ".join([*words[200:], f"x{i}"]) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(chain + clique)]
    found = jaccard_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, 85, sketch_bits=16)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == brute_components(rows, 4, 85)


def test_jaccard_keep_one(docs, empty):
    kept = jaccard_join.keep_one(docs, sketch_bits=16)
    assert kept.columns == docs.columns
    rows = Counter((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect())
    wordless = Counter((d, t) for d, t in texts_of(docs) if not (t or "").encode().split())
    assert all(rows[x] == n for x, n in wordless.items())
    # one row stays for each component, that of its smallest doc_id; the table has none without a doc_id
    want = Counter(d for d, n, c in brute_components(texts_of(docs), 5, 80) if n and d is not None and d == c)
    stays = Counter(d for (d, t), n in rows.items() for _ in range(n) if (d, t) not in wordless)
    assert set(stays) == set(want) and max(stays.values()) <= 2 and stays[7] == want[7]
    assert jaccard_join.keep_one(empty, sketch_bits=16).count() == 0
    assert jaccard_join.linked_components(empty, sketch_bits=16).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert found[start] == min(seen)
    assert set(found) == set(near)


# --- mixing ---


def check_mix(rows, shares):
    """Windows, phases and the deviation of less than one block at every slot of each phase."""
    by = defaultdict(list)
    for r in rows:
        by[r.src].append(r)
    blocks = {}
    for src, own in by.items():
        own.sort(key=lambda r: r.before)
        assert [r.block for r in own] == sorted(r.block for r in own)
        blocks[src] = {r.block: r.slot for r in own}
    used = [s for b in blocks.values() for s in b.values()]
    assert len(used) == len(set(used))
    assert all(r.release <= r.slot < r.deadline for r in rows)
    least = min(blocks, key=lambda s: -(-(max(blocks[s]) + 1) // shares[s]))
    h = sum(shares[s] for s in blocks)
    end = (max(blocks[least]) + 1) // shares[least] * h  # whole rounds with every source
    for src, b in blocks.items():
        if sorted(b) == list(range(max(b) + 1)):  # no document spans blocks
            for t in range(1, end + 1):
                assert abs(sum(s < t for s in b.values()) - t * shares[src] / h) < 1


@pytest.mark.parametrize("shares", [{"a": 3, "b": 2, "c": 1}, {"a": 7, "b": 7, "c": 5}, {"a": 1, "b": 1, "c": 40}])
def test_mix_windows(spark, shares):
    rows = [(i, "x" * 99, "aabcccc"[i % 7]) for i in range(700)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shares, block_chars=100).collect()
    assert sorted(r.doc.doc_id for r in found) == list(range(700))
    check_mix(found, shares)


def test_mix_keeps_all_rows(docs, empty):
    mixed = mixing.mixed(docs, block_chars=64)
    assert mixed.columns == docs.columns
    count = lambda df: Counter(tuple(r) for r in df.collect())
    assert count(mixed) == count(docs)
    assert mixing.mixed(empty).count() == 0
    found = mixing.mix(docs, block_chars=64).collect()
    check_mix(found, {r.src: r.share for r in found})
    assert mixing.mix(docs, {"a": 2, "nowhere": 9}, block_chars=64).count() == docs.count()


def test_mix_bins(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN_ROWS", 16)
    rows = [(i, "y" * (i % 50), "hot" if i % 3 else "cold") for i in range(500)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_chars=200).collect()
    for src in ("hot", "cold"):
        own = sorted((r.before, len(r.doc.text)) for r in found if r.src == src)
        at = 0
        for before, size in own:
            assert before == at
            at += size + 1


# --- exact dedup ---


@pytest.mark.parametrize("bits", [1 << 28, 1 << 18])
def test_exact_dedup(docs, bits, monkeypatch):
    if bits == 1 << 18:  # several waves
        monkeypatch.setattr(exact_dedup, "SLICE_BITS", 64)
    found = exact_dedup.duplicate_groups(docs, filter_bits=bits if bits > 1 << 18 else 512).collect()
    groups = defaultdict(list)
    for d, t in texts_of(docs):
        groups[t or ""].append(d)
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert Counter(r.doc_id for r in found) == Counter(d for ids in groups.values() for d in ids)
    kept = Counter()
    for r in found:
        ids = by[r.text_sha256]
        best = max((d for d in ids if d is not None), default=None)
        assert (r.keep_id, r.group_size) == (best, len(ids)) and (not r.kept or r.doc_id == best)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_exact_dedup_stage(docs, empty):
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    best = {}
    for d, t in texts_of(docs):
        best[t or ""] = max(best.get(t or "", -1), -1 if d is None else d)
    assert Counter((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in kept.collect()) == Counter(best.items())
    assert exact_dedup.drop_duplicates(empty).count() == 0
    assert exact_dedup.duplicate_groups(empty).count() == 0


# --- quality ---


def test_quality_measures(docs, empty):
    found = quality.judge(docs, with_text=True).collect()
    assert len(found) == docs.count()
    want = defaultdict(set)
    for d, t in texts_of(docs):
        t = t or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        seen, twice = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                twice += line in seen
                seen.add(line)
        want[d].add((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), twice, len(covered)))
    for r in found:
        measures = tuple(r[m] for m in quality.MEASURES)
        assert measures in want[r.doc_id]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality.judge(empty).count() == quality.keep_good(empty).count() == 0


def test_quality_lines():
    good = "Then the others came home and nobody had seen them since the day before."
    assert quality.fault(good, set()) is None
    for line, fault in {
        "Home | News | About us | Contact": "navigation", "Please enable JavaScript to view this page.": "boilerplate",
        "!!! *** ###": "punctuation", "THIS!! IS!! A!! SALE!!": "punctuation", "BUY THIS NOW AND SAVE": "shouting",
        "go go go go to to to to": "repetition", "if (x) { return 1 }": "boilerplate",
    }.items():
        assert quality.fault(line, set()) == fault, line
    seen = set()
    assert [quality.fault(good, seen) for _ in range(2)] == [None, "repetition"]
    text, kept = quality.clean(f"{good}\nHome | News | About us | Contact\n{good[:-2]}.")
    assert kept and text == f"{good}\n{good[:-2]}."
    assert not quality.clean("Home | News | About us | Contact\nHello there you all.")[1]


def test_quality_stage_keeps_columns(docs):
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema
    assert kept.count() == quality.judge(docs).filter("kept").count()
    assert all(r.n_chars == len(r.text) for r in kept.collect())


# --- fuzzy lines ---


def test_fuzzy_lines(spark, docs, empty):
    base = "the quick brown fox jumps over the lazy dog while nobody is looking at all tonight in the yard"
    rows = [(1, base + "\nshort"), (2, base.replace("lazy", "lame")), (3, "  " + base.upper() + " \nshort\n\n"), (4, None),
            (5, "something else entirely is written in this line, with other words and other ends")]
    found = fuzzy_lines.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no, r.class_lines, r.kept) for r in found}
    assert got == {(1, 0): (1, 0, 3, True), (2, 0): (1, 0, 3, False), (3, 0): (1, 0, 3, False),
                   (1, 1): (1, 1, 2, True), (3, 1): (1, 1, 2, False), (5, 0): (5, 0, 1, True)}
    assert fuzzy_lines.line_classes(empty).count() == 0
    lines = sum(1 for _, t in texts_of(docs) for line in (t or "").split("\n") if line.strip(" \t\r\x0b\x0c"))
    assert fuzzy_lines.line_classes(docs).count() == lines


def test_fuzzy_lines_against_brute_force(spark):
    import random

    rng = random.Random(9)
    lines = []
    for _ in range(25):
        line = cases.sentence(rng, rng.randint(6, 30)).lower()
        lines.append(line)
        for _ in range(rng.randint(0, 4)):
            words = line.split()
            words[rng.randrange(len(words))] = "zq" + str(rng.randint(0, 9))
            lines.append(" ".join(words))
    found = fuzzy_lines.line_classes(spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")).collect()
    k = fuzzy_lines.K
    sets = [{t[i : i + k] for i in range(max(1, len(t) - k + 1))} for t in lines]
    parent = list(range(len(lines)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    got = {r.doc_id: r.keep_doc_id for r in found}
    wrong = [i for i in range(len(lines)) if got[i] != top(i)]
    assert len(wrong) <= 1, wrong  # banding may miss a pair


def test_fuzzy_lines_plan_is_native(docs):
    plan = fuzzy_lines.line_classes(docs)._jdf.queryExecution().executedPlan().toString()
    plan += mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- WARC ---


def test_warc(spark, empty):
    big, other = "<p>" + "é" * 600 + "</p>", "<p>" + "z" * 2000
    rows = [(1, "http://x/1", big), (2, None, big), (3, "http://x/ä b\r\nX: y", other), (4, "u", None), (5, "u", ""),
            (6, "u", "same"), (7, "u", "same"), (8, "u", big), (None, "u", big), (9, "u", "x\r\n\r\ny" * 900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r.page_id: r for r in warc.round_trip(spark, pages, frame_bytes=3000).collect()}
    assert len(found) == len(rows)
    for page, url, html in rows:
        raw, r = (html or "").encode(), found[page]
        keeper = 8 if html == big else page
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if page == keeper else ("revisit", keeper))
        assert r.payload is None if page != keeper else bytes(r.payload) == raw
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(spark, none).count() == 0


def test_bundle_frames():
    out = io.BytesIO()
    writer = warc.BundleWriter(out, frame_bytes=500)
    records = [bytes([i]) * (37 * i) for i in range(30)]
    places = [writer.add(r) for r in records]
    writer.close()
    reader = warc.BundleReader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert len(reader.frames) > 5
    for r, (frame, at) in zip(records, places):
        assert reader.frame(frame)[at : at + len(r)] == r


# --- language ---


def test_language_gradient_and_posteriors():
    rng = np.random.default_rng(0)
    e, step, label = rng.normal(size=(8, 3)), rng.normal(size=(3, 3)), rng.integers(0, 3, 8)
    first = np.array([0, 4, 8])

    def paths(e, step):
        from itertools import product

        out = []
        for a, b in ((0, 4), (4, 8)):
            out.append({p: math.exp(sum(e[a + i, x] for i, x in enumerate(p)) + sum(step[x, y] for x, y in zip(p, p[1:]))) for p in product(range(3), repeat=4)})
        return out

    def log_likelihood(e, step):
        return sum(math.log(p[tuple(label[a : a + 4])] / sum(p.values())) for p, a in zip(paths(e, step), (0, 4)))

    post = language_crf.posteriors(e.copy(), step, first)
    for part, a in zip(paths(e, step), (0, 4)):
        for i in range(4):
            for x in range(3):
                assert post[a + i, x] == pytest.approx(sum(v for p, v in part.items() if p[i] == x) / sum(part.values()))
    slope, pull = language_crf.gradient(e, step, first, label)
    for i, j in ((0, 1), (5, 2), (7, 0)):
        up = e.copy()
        up[i, j] += 1e-5
        assert slope[i, j] == pytest.approx((log_likelihood(up, step) - log_likelihood(e, step)) / 1e-5, abs=1e-3)
    for i, j in ((0, 1), (2, 2)):
        up = step.copy()
        up[i, j] += 1e-5
        assert pull[i, j] == pytest.approx((log_likelihood(e, up) - log_likelihood(e, step)) / 1e-5, abs=1e-3)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = language_crf.learn_and_predict(docs).join(docs, "doc_id").filter("held_out")
    right, n = found.select(F.sum((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 20 and right >= 0.95 * n


def test_language_odd_rows(docs, empty):
    found = {(r.doc_id, r.lang_pred) for r in language_crf.learn_and_predict(docs).collect()}
    text = dict(texts_of(docs))
    for doc_id, label in found:
        if doc_id is not None and doc_id != 7:
            assert (label == "und") == (not re.search(r"[^\W\d_]", text[doc_id] or ""))
    assert language_crf.learn_and_predict(empty).count() == 0
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_crf.learn_and_predict(bare).collect()} == {"und"}


def test_language_switch():
    rng = np.random.default_rng(3)
    vocab = {"x": ["abab", "baba", "abba"], "y": ["zoz", "ozo", "zzo"]}
    rows = [(" ".join(rng.choice(vocab[v], 60)), v) for v in "xyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxy"]
    model = language_crf.fit(rows)
    post, first = language_crf.word_labels(pa.array(["abab baba abba baba zoz ozo zzo zoz"]), model)
    assert [model.labels[i] for i in post.argmax(axis=1)] == ["x"] * 4 + ["y"] * 4


# --- id planes ---


@pytest.mark.parametrize("kind", [1, 8])
def test_planes(kind):
    rng = np.random.default_rng(4)
    for n in (1, 7, 8, 1000):
        ids = rng.integers(0, 1 << 32, n).astype("<u4")
        assert (bitplanes.ids_of(bitplanes.planes(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize("kind,chunk", [(1, 64), (8, 1 << 16)])
def test_plane_files(spark, docs, tokenizer, kind, chunk):
    found = bitplanes.round_trip(spark, docs, kind=kind, chunk=chunk).orderBy("start").collect()
    want = Counter((d, ids_of(tokenizer, t).tobytes()) for d, t in texts_of(docs))
    assert Counter((r.doc_id, bytes(r.ids)) for r in found) == want
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))


def test_plane_files_of_nothing(spark, empty):
    assert bitplanes.round_trip(spark, empty).count() == 0


def test_plane_reader_range():
    out = io.BytesIO()
    writer = bitplanes.Writer(out, chunk=16)
    ids = np.arange(1000, dtype="<u4") * 77777
    for a in range(0, 1000, 130):
        writer.document(ids[a : a + 130].tobytes())
    writer.close()
    reader = bitplanes.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    for a, b in ((0, 1000), (5, 5), (15, 17), (999, 1000), (100, 517)):
        assert (reader.range(a, b) == ids[a:b]).all()
