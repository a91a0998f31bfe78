"""Strings of added tokens in a text are those tokens, as in the library."""

from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from oddsloom.llm import bitplanes, packing
from oddsloom.llm.tokens import Encoder, default_vocabulary

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b c d", "x\n<|endoftext|>\ny", "<|endoftext|><|endoftext|> .",
         "a <|endoftext| > b", "a  b<|endoftext|>", "plain words only", "<|endoftext|>\n", "and <|ENDOFTEXT|> too", ""]


def test_encoder_equals_library_on_added_tokens():
    tokenizer = Tokenizer.from_file(default_vocabulary())
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in TEXTS]
    assert list(np.frombuffer(want[0], "<u4")) == [64, 220, 50256, 275]
    encoder = Encoder(default_vocabulary(), kept=5)
    assert encoder.encode(TEXTS) == want
    assert encoder.encode(TEXTS[::-1]) == want[::-1]


def test_queries_on_added_tokens(spark):
    tokenizer = Tokenizer.from_file(default_vocabulary())
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in TEXTS]
    back = {r.doc_id: r for r in bitplanes.round_trip(spark, docs).collect()}
    assert [list(np.frombuffer(back[i].ids, "<u4")) for i in range(len(TEXTS))] == want
    assert [back[i].start for i in range(len(TEXTS))] == [sum(map(len, want[:i])) for i in range(len(TEXTS))]
    pieces = packing.pack(docs, context=8).collect()
    assert Counter((p.doc_id, p.start, p.doc_tokens) for p in pieces) == Counter(
        (i, sum(packing.binary_lengths(len(w), 8)[:k]), len(w)) for i, w in enumerate(want) for k in range(len(packing.binary_lengths(len(w), 8))))
