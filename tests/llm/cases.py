"""A small table with nulls, empty and long texts, ties, repeated rows and columns whose names operators use inside."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, node long, n long, key string, "
          "sha string, maybe boolean, doc string, id long, h long, row long, slot int, block int, h2 string")
SYLLABLES = "the an ti on er re st en ly wh ou ha in ed of".split()


def sentence(rng, words):
    made = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(words)]
    return " ".join(made).capitalize() + "."


def texts(rng):
    base = ["\n".join(sentence(rng, rng.randint(8, 20)) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    near = [t.replace(" the", " zzz", 1) for t in base[:12]]
    odd = [None, "", " ", "\n\n", "a", "A a", "é ß 日本 語。", "x " * 3000, "1234 5678", sentence(rng, 4000),
           "one two three", "ONE two\tthree", "word " * 12, "\x1c\x1d \x85 b"]
    return base + base[:6] + near + odd + odd


def rows(seed=5):
    rng = random.Random(seed)
    out = []
    for i, t in enumerate(texts(rng)):
        out.append((i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None]), len(t or ""), 1, 2, "k", "s", True, "d", 3, 4, 5, 6, 7, "x"))
    out.append(out[3])  # a repeated row
    out.append((None, out[4][1], *out[4][2:]))
    out.append((None, None, None, None, None, *out[4][5:]))
    out.append((7, "another text under a doc_id that is taken, of some length", *out[4][2:]))
    return out


def table(spark, found=None):
    return spark.createDataFrame(rows() if found is None else found, SCHEMA)
