"""Quality rules, line first.

Every line with a word is judged by itself; a line that fails is taken out of the text. Lines fail as

* boilerplate: script, cookie, policy, licence, login or placeholder phrases (``PHRASES``, whole words, with the words that
  ``FORMS`` lets go with them) that make up at least ``PHRASE_SHARE`` of the line's letters and digits, or braces as of code: a line with
  one whose marks of code are at least ``CODE_SHARE`` of its characters;
* navigation: items separated by bars, bullets or arrows, or a line whose words are mostly links;
* punctuation: no letter at all, marks making up more than ``mark_share`` of its characters, or a mark that is
  repeated at the end of most of its words;
* shouting: most letters of a longer line are capitals;
* repetition: a line of ``repeat_words`` words or more that came before in the same text, or one whose words mostly
  repeat the word before.

Then the document is judged by what the lines lost: it is rejected when more than ``lost_share`` of the characters in
its words is gone, or fewer than ``min_words`` words are left. Independently of the method the base measures reject
a document with fewer than 10 words or with more than 20 % of its words in repeated five-word windows.

One pass over whole texts without a shuffle. Null text has no words and is rejected; empty table: no rows; repeated
rows are judged alike; other columns pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHRASES = (
    "javascript", "cookie policy", "cookies policy", "privacy policy", "terms of use", "terms of service",
    "terms and conditions", "use of cookies", "uses cookies", "use cookies", "accept cookies", "lorem ipsum",
    "all rights reserved", "click here", "read more", "sign in", "sign up", "log in", "subscribe to", "skip to content", "skip to main content",
    "back to top", "share this", "powered by", "page not found", "access denied", "copyright",
)
# how phrases stand in boilerplate: with the words around them that belong to the notice
SITE = r"(?:we|(?:this|our|the) (?:web ?)?(?:site|page))"
LEGAL = r"(?:cookies? policy|privacy policy|terms of (?:use|service)|terms and conditions)"
YOURS = r"(?: (?:to|for|with) (?:your account|our newsletter|continue|comment|reply|facebook|google))?"
FORMS = re.compile(r"\b(?:" + "|".join((
    r"(?:please )?(?:enable|activate|turn on) javascript(?: (?:in|on) your browser)?(?: (?:to|in order to) \w+ (?:this|the|our) \w+)?",
    rf"{SITE} (?:requires?|uses?|needs?) javascript", r"javascript (?:is|must be|has to be) (?:not |currently )?(?:enabled|disabled|required)(?: in your browser)?",
    r"(?:your browser|you) (?:does not|do not|doesn't|don't) (?:support|have) javascript(?: enabled)?", "javascript",
    rf"(?:by \w+ (?:\w+ ){{0,4}}you (?:agree|consent) to |(?:i|you) (?:agree to|accept) |(?:read|see|view) )?(?:(?:our|the) )?{LEGAL}(?:(?: and|,| &| \|) (?:(?:our|the) )?{LEGAL})*",
    rf"{SITE} uses? cookies(?: (?:to|for) [^.!?]*)?", rf"by \w+ (?:\w+ ){{0,4}}you (?:agree|consent) to (?:our |the )?use of cookies", r"(?:the |our )?use of cookies", r"uses? cookies", r"accept (?:all )?cookies",
    r"lorem ipsum(?: dolor sit amet)?(?:,? consectetur adipiscing elit)?", r"all rights reserved", r"click here(?: (?:to|for) (?:\w+ ){0,2}\w+)?", r"read more",
    rf"(?:please )?(?:sign|log) (?:in|up)(?: (?:or|and) (?:register|(?:sign|log) (?:in|up)))?{YOURS}",
    r"subscribe to (?:our|the|this)(?: \w+)?", r"subscribe to", r"skip to (?:main )?content", r"back to top", r"share this(?: (?:page|post|article|story|entry))?(?: (?:on|via|with) \w+)?",
    r"(?:proudly )?powered by(?: \w+)?", r"(?:error )?(?:404 )?page not found", r"access denied", r"copyright(?:\W+(?:c\b)?\W*\d{4}(?:\W{1,3}\d{4})?)?(?: by)?",
)) + r")\b")
PHRASE_SHARE, CODE_SHARE = 0.5, 0.125
CODE = "{}()[];:=<>\""
LETTERS = re.compile(r"\w")
PHRASE_WORDS = 25  # a longer line with a phrase in it is prose that mentions it
BARS = re.compile(r"(?<!\S)[|•·»›>→](?!\S)")
BAR = re.compile("[|•·»›>→]")
CAPITALS = re.compile("[A-ZÀ-ÖØ-Þ]+")
MARKS = re.compile(r"[^\w\s]+|_+")
MARKED = re.compile(r"[!?#$*%&]{2,}[\"')]*$|[#$*%&]$")
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Rules(NamedTuple):
    mark_share: float = 0.3
    lost_share: float = 0.5
    min_words: int = 5
    repeat_words: int = 3
    shout_share: float = 0.7


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = text.encode()
    words = raw.split()  # of bytes: cuts at space and \x09-\x0D alone
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    gaps = len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c"))
    return n, len(text) - gaps, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], k: int = 5) -> int:
    """Words inside a window of k words that the text holds twice or more."""
    windows = list(zip(*(words[j:] for j in range(k))))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = reach = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + k - max(reach, i)
            reach = i + k
    return covered


def _phrase_share(low: str) -> float:
    """The share of a line's letters and digits that stands in phrases."""
    low = " ".join(low.split())
    size = len(LETTERS.findall(low))
    return sum(len(LETTERS.findall(m)) for m in FORMS.findall(low)) / size if size else 0.0


def fault(line: str, earlier: set[str], rules: Rules = Rules()) -> str | None:
    """The rule that a line with a word breaks, or None."""
    words = line.split()
    n = len(words)
    if n >= rules.repeat_words:
        if line in earlier:
            return "repetition"
        earlier.add(line)
    if "{" in line and sum(map(line.count, CODE)) >= CODE_SHARE * sum(map(len, words)):
        return "boilerplate"
    if n <= PHRASE_WORDS:
        low = line.lower()
        if any(p in low for p in PHRASES) and _phrase_share(low) >= PHRASE_SHARE:
            return "boilerplate"
    bars = len(BARS.findall(line)) if BAR.search(line) else 0
    if bars >= 2 and 3 * bars >= n - bars or n >= 2 and "://" in line and 2 * line.count("://") > n:
        return "navigation"
    chars = sum(map(len, words))
    marks = MARKS.findall(line)
    plain = chars - sum(map(len, marks))
    if plain <= 0 or chars - plain > rules.mark_share * chars:
        return "punctuation"
    if n >= 3 and 2 * len(marks) > n and 2 * sum(1 for w in words if MARKED.search(w)) > n:
        return "punctuation"
    if n >= 4 and len(CAPITALS.sub("", line)) < len(line) - rules.shout_share * plain:
        return "shouting"
    if n >= 6 and 5 * sum(map(str.__eq__, words, words[1:])) > 2 * n:
        return "repetition"
    return None


def clean(text: str, rules: Rules = Rules()) -> tuple[str, bool]:
    """The text without its failing lines, and whether the document stays by the method."""
    earlier: set[str] = set()
    left, total, stays = [], 0, 0
    for line in text.split("\n"):
        size = len(line) - sum(map(line.count, " \t\r\x0b\x0c"))
        if size:
            total += size
            if fault(line, earlier, rules):
                continue
            stays += size
        left.append(line)
    cleaned = "\n".join(left)
    kept = total > 0 and total - stays <= rules.lost_share * total and len(cleaned.encode().split()) >= rules.min_words
    return cleaned, kept


def _judged(text: str, rules: Rules) -> tuple:
    found = measures(text)
    failed = found[0] < 10 or 100 * found[4] > 20 * found[0]
    cleaned, kept = clean(text, rules)
    return *found, failed, kept and not failed, cleaned


def judge(docs: DataFrame, rules: Rules = Rules(), with_text: bool = False) -> DataFrame:
    """doc_id, the measures, base_failed, kept; with ``with_text`` also clean_text."""
    kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.string()] * with_text
    names = ["doc_id", *MEASURES, "base_failed", "kept", *["clean_text"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [_judged(t or "", rules)[: 7 + with_text] for t in part.column(1).to_pylist()]
                columns = [part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds[1:]))]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", base_failed boolean, kept boolean" + ", clean_text string" * with_text
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that stay, with cleaned text (and n_chars of it), in one pass without a shuffle."""
    columns = docs.columns
    place = columns.index("text")
    counted = columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [_judged(t or "", rules) for t in part.column(place).to_pylist()]
                arrays = list(part.columns)
                arrays[place] = pa.array([r[-1] for r in rows], part.schema.field(place).type)
                if counted is not None:
                    arrays[counted] = pa.array([len(r[-1]) for r in rows]).cast(part.schema.field(counted).type)
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema).filter(pa.array([r[-2] for r in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
