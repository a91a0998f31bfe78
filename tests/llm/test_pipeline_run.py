"""The whole corpus pipeline on a small table against brute force, the order of the mix included."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from oddsloom.llm import packing
from oddsloom.llm.tokens import default_vocabulary

from . import cases
from .test_llm_operators import brute_components, ids_of

BAR = "Home | News | About us | Contact"


def fixture():
    """(doc_id, text, source) and the texts that are left by the quality rules."""
    rng, rows, clean = random.Random(3), [], {}
    for i in range(150):
        lines = [cases.sentence(rng, rng.randint(8, 20)) for _ in range(rng.randint(20, 90))]
        clean[i] = "\n".join(lines)
        rows.append((i, "\n".join([BAR, *lines]) if i % 4 == 0 else clean[i], ["a", "a", "a", "b", "b", None][i % 6]))
    for i in range(150, 160):  # nothing stays of these
        rows.append((i, f"{BAR}\n{BAR}", "a"))
    for i in range(160, 170):  # exact copies: the larger doc_id stays
        clean[i] = clean.pop(i - 160)
        rows.append((i, clean[i], "b"))
    for i in range(170, 180):  # near copies: the smaller doc_id stays
        clean[i] = clean[i - 150] + "\n" + cases.sentence(rng, 9)
        rows.append((i, clean[i], "a"))
    rng.shuffle(rows)
    return rows, clean


def brute_mix(docs, chance, block=1 << 15, slots=1000):
    """doc_ids in the order of the mix, for sources whose blocks fit one round."""
    own = defaultdict(list)
    for d, text, source in docs:
        own["-" if source is None else "+" + source].append((chance[d], d, len(text) + 1))
    root = {s: math.sqrt(sum(n for *_, n in rows)) for s, rows in own.items()}
    share = {s: max(1, math.floor(slots * r / sum(root.values()) + 0.5)) for s, r in root.items()}
    assert all(-(-sum(n for *_, n in rows) // block) <= share[s] for s, rows in own.items())
    h, done, slot_of = sum(share.values()), dict.fromkeys(share, 0), {}
    for t in range(h):
        ready = [(-(-(done[s] + 1) * h // a), s) for s, a in share.items() if done[s] < a and done[s] * h // a <= t]
        if ready:
            s = min(ready)[1]
            slot_of[s, done[s]] = t
            done[s] += 1
    order = []
    for s, rows in own.items():
        before = 0
        for _, d, n in sorted(rows):
            order.append((slot_of[s, before // block], before, d))
            before += n
    return [d for *_, d in sorted(order)]


def test_run_against_brute_force(spark, tmp_path):
    rows, clean = fixture()
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    table = table.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"))
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the mix is a table of several files
    try:
        found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

    source = {d: s for d, _, s in rows}
    left = brute_components(sorted(clean.items()), 5, 80)
    stay = [(d, clean[d], source[d]) for d, _, c in left if d == c]
    assert len(stay) < len(clean) < len(rows)
    chance = dict(table.select("doc_id", F.xxhash64(F.lit("mix"), "doc_id")).collect())
    tokenizer, want = Tokenizer.from_file(default_vocabulary()), []
    for d in brute_mix(stay, chance):
        ids, start = ids_of(tokenizer, clean[d]), 0
        for length in packing.binary_lengths(len(ids), 1024):
            want.append((d, start, length, ids[start : start + length].tobytes()))
            start += length
    assert [(p.doc_id, p.start, p.length, bytes(p.ids)) for p in sorted(found, key=lambda p: p.sequence_id)] == want
    assert len({p.sequence_id for p in found}) == len(found)


@pytest.mark.parametrize("context", [1, 2, 1024, 1 << 31])
def test_piece_bits_hold_the_longest_document(context):
    n = (1 << 31) - 1
    most = n // context + context.bit_length()  # whole contexts and a piece for each bit of the rest
    assert most <= 1 << packing.piece_bits(context) and packing.piece_bits(context) < 40
