"""Runs of keys lie in small rows, are worked on together, and lose nothing."""

import numpy as np

from oddsloom.llm import phrases


def test_rows_hold_whole_runs(monkeypatch):
    monkeypatch.setattr(phrases, "RUN_KEYS", 10)
    rng = np.random.default_rng(5)
    runs = np.concatenate([[0, *rng.integers(1, 9, n)] for n in (2, 3, 25, 1, 9, 10, 2, 2)]).astype(np.uint64)
    rows = list(phrases.rows_of_runs(runs))
    assert (np.concatenate(rows) == runs).all() and all(r[0] == 0 for r in rows)
    assert all(len(r) <= 10 or (r == 0).sum() == 1 for r in rows) and len(rows) < (runs == 0).sum()
    assert not list(phrases.rows_of_runs(np.zeros(0, np.uint64)))


def test_texts_make_small_rows(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(" ".join(words) + ".\n", "en")] * 300, "text string, lang string").coalesce(1)
    monkeypatch.setattr(phrases, "RUN_KEYS", 1000)
    marks = np.full(phrases.SLICE // 8, 255, np.uint8)
    runs = phrases.key_runs(docs, marks, 16)
    assert runs.count() >= 12
    sizes = [len(r) for r in phrases.runs_of(iter([runs.toArrow().to_batches()[0]]))]
    assert sum(sizes) == 300 * 41 and len(sizes) == 1

