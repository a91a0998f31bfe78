"""Token ids of whole texts by a public byte-level BPE vocabulary.

The ids are those that ``Tokenizer.encode(text, add_special_tokens=False)`` gives; the string of an added token in a text
is that token. The vocabulary's pattern always breaks before a space that is followed by a non-space, and around a
single line feed between non-spaces; so a text is cut there, every distinct piece is encoded once and kept, and a
text is the concatenation of its pieces. Texts with other white space
or with an added token's string are encoded whole.
"""

from __future__ import annotations

import ctypes
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT = 1_000_000  # pieces in each of the two generations of a worker's cache
BATCH = 256  # texts worked on at a time
MARKS = ".,;:!?"
_SPACE = re.compile(r"\s")
_encoders: dict[str, Encoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_names() -> dict[int, str]:
    """The characters that byte-level vocabularies write bytes as: printable ones as they are, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, vocabulary: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.kept, self.young, self.old = kept, {}, {}
        self.byte_names = _byte_names()
        self.space = self.byte_names[32]
        self.feed = self._raw(["\n"])[0]
        runs = [m * k for m in MARKS for k in (1, 2, 3)]
        self.marks = dict(zip(runs, self._raw(runs)))

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, word: str, space: bool) -> bytes:
        """Ids of a word of letters, one space before it or none: a single unit of the vocabulary's pattern."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.byte_names)
        return array("I", [t.id for t in self.model.tokenize(self.space + word if space else word)]).tobytes()

    def _learn(self, pieces: set[str]) -> None:
        """Put the pieces into the young generation; False marks one that can't be cut out of its text."""
        old, young, new = self.old, self.young, []
        for p in pieces:
            if (v := old.get(p)) is not None:
                young[p] = v
                continue
            feed = p[:1] == "\n"
            own = p[1:] if feed else p
            core = own.rstrip(MARKS)
            if core.isalpha() and (core == own or own[len(core) :] in self.marks):
                word = self._letters(core, not feed)
                young[p] = (self.feed if feed else b"") + word + self.marks.get(own[len(core) :], b"")
            elif not own or _SPACE.search(own):
                young[p] = False
            else:
                new.append(p)
        young.update(zip(new, self._raw([p if p[0] == "\n" else " " + p for p in new])))

    def encode(self, texts: list[str]) -> list[bytes]:
        special = {i for i, t in enumerate(texts) if any(s in t for s in self.added)}
        cut = [[] if i in special else ("\n" + t).replace("\n", " \n").split(" ")[1:] for i, t in enumerate(texts)]
        distinct = set().union(*cut)
        if len(self.young) > self.kept:
            self.young, self.old = {}, self.young
        self._learn(distinct.difference(self.young))
        get, out, whole = self.young.get, [], sorted(special)
        for i, pieces in enumerate(cut):
            try:
                out.append(b"".join(map(get, pieces))[4:])  # without the line feed put before
            except TypeError:  # a piece that can't be cut out
                whole.append(i)
                out.append(b"")
        for i, ids in zip(whole, self._raw([texts[i] for i in whole])):
            out[i] = ids
        return out


def release() -> None:
    """Forget the pieces that this worker has encoded, and give freed memory back: other operators' tasks need it."""
    for enc in _encoders.values():
        enc.young, enc.old = {}, {}
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder; it outlives a task, so pieces are encoded once in a worker."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def encoded(column: pa.Array, vocabulary: str, end: int) -> Iterator[tuple[int, bytes]]:
    """(row, ids with the end id) of every text of a batch; null counts as empty."""
    tail, enc = np.array([end], "<u4").tobytes(), encoder(vocabulary)
    column = pc.fill_null(column, "")
    for at in range(0, len(column), BATCH):
        for i, ids in enumerate(enc.encode(column.slice(at, BATCH).to_pylist())):
            yield at + i, ids + tail
