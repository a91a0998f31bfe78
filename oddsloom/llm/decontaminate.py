"""Benchmark decontamination by a distributed positional inverted index. DataFrame operations only.

1. Index. Every word of the training texts that is a term of a test item becomes a posting (term, row, pos). Each task
   writes the postings of its own rows as a shard, sorted by term, so a term's list is one run in each shard and readers skip
   the rest. Nothing is shuffled. The first posting of a text also carries doc_id and the number of words.
2. Rarest terms. Postings are counted by term; in each window of ``window`` consecutive item words (an item of fewer is one
   window) the terms are ordered by that count. A window with a term that has no posting occurs nowhere.
3. Intersection. The list of a window's rarest term, its positions shifted back by the term's place in the item, gives
   (row, item, shift); it is intersected with the shifted list of the second rarest term, and only what is left with the
   lists of all other terms. A window is found where all its terms stand at the same shift.
4. ``slop`` lets each term stand up to that many places from where the rarest term puts it: proximity matches. The exact
   phrases are those of slop 0.

Terms of test items are joined to the words as a broadcast while they take less than ``SMALL`` bytes, by a shuffle that
Spark can split beyond it; the same holds for each list of candidates. A very frequent term is never a group of its own:
lists are joined, not collected, and only the window's rarest list is read whole.

Null, empty or wordless text: no words, no hits. Null doc_id: a row as any other. Repeated rows and doc_ids: rows of their own. Very
long texts are indexed whole. Items without words have no window; repeated item_ids count once a row; an item without
item_id marks words but isn't listed. Empty training table: no rows; empty benchmark: no hits. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import passing_tables, settled

SMALL = 32 << 20  # bytes of a table that is broadcast
CAPITALS, SMALLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in order: digits, letters and everything that isn't ASCII; only A-Z are lower-cased."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), CAPITALS, SMALLS)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def hinted(small: DataFrame, row_bytes: int) -> DataFrame:
    """``small``, a settled table, marked for broadcast while its rows take less than ``SMALL`` bytes."""
    return F.broadcast(small) if small.count() * row_bytes < SMALL else small


def test_terms(items: DataFrame, window: int) -> DataFrame:
    """item (a number), item_id, q, word and n (the item's words) for every word of every item."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
    rows = rows.filter(F.size("words") > 0).withColumn("item", F.monotonically_increasing_id())
    return settled(rows.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("q", "word")), "test-terms")


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings (term, row, pos) of the vocabulary's words (word, term); the first of each row also has doc_id and n_words,
    with term null where it isn't a term of any item."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("row"))
    flat = rows.select("row", "doc_id", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    found = flat.join(vocabulary, "word", "left").filter(F.col("term").isNotNull() | first)
    postings = found.select(
        "term", "row", "pos", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("n_words")).alias("n_words"))
    return settled(postings.sortWithinPartitions("term", "row", "pos"), "postings", stays=True)


def windows(terms: DataFrame, window: int) -> DataFrame:
    """item, w (the window's first place), size, k (1 for its rarest term), q, term of every window whose terms all have postings."""
    last = F.greatest(F.col("n") - window, F.lit(0))
    spread = terms.select(
        "item", "q", "term", "freq", F.least(F.col("n"), F.lit(window)).alias("size"),
        F.explode(F.sequence(F.greatest(F.col("q") - window + 1, F.lit(0)), F.least(F.col("q"), last))).alias("w"))
    rarest = Window.partitionBy("item", "w").orderBy("freq", "q")  # at most ``window`` rows
    every = Window.partitionBy("item", "w")
    spread = spread.withColumn("k", F.row_number().over(rarest)).withColumn("least", F.min("freq").over(every))
    return spread.filter("least > 0").select("item", "w", "size", "k", "q", "term")


def occurrences(postings: DataFrame, terms: DataFrame, window: int = 10, slop: int = 0) -> DataFrame:
    """row, item, w, size, shift, from_pos, to_pos: every place of every window of the items. ``terms``: item, q, n, term, freq."""
    found = settled(windows(terms, window), "windows")
    lists = postings.filter("term is not null").select("term", "row", "pos")

    def around(place: Column) -> Column:
        return F.explode(F.sequence(place - slop, place + slop)).alias("pos")

    # the rarest term's list, shifted back by its place in the item
    rarest = settled(found.filter("k = 1").select("term", "item", F.col("q").alias("q1")).distinct(), "rarest")
    start = lists.join(hinted(rarest, 32), "term").select("row", "item", "q1", (F.col("pos") - F.col("q1")).alias("shift"))

    # intersected with the second rarest term's list; a window of one term has none
    second = found.filter("k = 2").select("item", "w", F.col("q").alias("q2"), F.col("term").alias("term2"))
    pairs = found.filter("k = 1").select("item", "w", "size", F.col("q").alias("q1")).join(second, ["item", "w"], "left")
    pairs = settled(pairs.groupBy("item", "q1", "q2", "term2").agg(F.collect_list(F.struct("w", "size")).alias("ws")), "second-rarest")
    open_ = settled(start.join(hinted(pairs, 200), ["item", "q1"]), "candidates")
    wanted = settled(found.filter("k = 2").select("term").distinct(), "second-terms")
    own = lists.join(hinted(wanted, 16), "term", "left_semi").select(F.col("row"), F.col("pos"), F.col("term").alias("term2"))
    asked = open_.filter("term2 is not null").select("*", around(F.col("shift") + F.col("q2")))
    both = asked.join(own, ["row", "pos", "term2"], "left_semi").select("row", "item", "shift", "ws")
    left = both.unionByName(open_.filter("term2 is null").select("row", "item", "shift", "ws"))
    left = settled(left.select("row", "item", "shift", F.inline("ws")).distinct(), "candidates")

    # and with the lists of all terms of the windows that are left
    places = left.select("row", "item", "shift", F.explode(F.sequence(F.col("w"), F.col("w") + F.col("size") - 1)).alias("q")).distinct()
    places = places.join(hinted(settled(terms.select("item", "q", "term"), "terms"), 32), ["item", "q"])
    places = places.select("row", "item", "shift", "q", "term", around(F.col("shift") + F.col("q")))
    rows = settled(left.select("row").distinct(), "rows")
    lists = lists.join(hinted(rows, 16), "row", "left_semi")
    met = places.join(lists, ["row", "pos", "term"]).groupBy("row", "item", "shift").agg(F.collect_set(F.struct("q", "pos")).alias("met"))
    full = left.join(met, ["row", "item", "shift"])
    inside = F.filter("met", lambda x: (x["q"] >= F.col("w")) & (x["q"] < F.col("w") + F.col("size")))
    full = full.withColumn("met", inside).filter(F.size(F.array_distinct(F.transform("met", lambda x: x["q"]))) == F.col("size"))
    place = F.transform("met", lambda x: x["pos"])
    return settled(full.select("row", "item", "w", "size", "shift", F.array_min(place).alias("from_pos"), F.array_max(place).alias("to_pos")), "occurrences")


def indexed(docs: DataFrame, items: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index, the items' terms with their counts in it, and the items' names (item, item_id)."""
    tests = test_terms(items, window)
    vocabulary = settled(tests.groupBy("word").agg(F.count("*").alias("n")).select("word", F.monotonically_increasing_id().alias("term")), "vocabulary")
    size = vocabulary.agg(F.sum(F.octet_length("word") + 24)).first()[0] or 0
    postings = build_index(docs, F.broadcast(vocabulary) if size < SMALL else vocabulary)
    counts = settled(postings.filter("term is not null").groupBy("term").agg(F.count("*").alias("freq")), "term-counts")
    terms = tests.join(vocabulary, "word").join(counts, "term", "left").select("item", "n", "q", "term", F.coalesce("freq", F.lit(0)).alias("freq"))
    return postings, settled(terms, "terms"), tests.select("item", "item_id").distinct()


def contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Every row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    with passing_tables():
        postings, terms, names = indexed(docs, items, window)
        found = occurrences(postings, terms, window)
        hit = found.select("row", F.explode(F.sequence("from_pos", "to_pos")).alias("pos")).distinct()
        hit = hit.groupBy("row").agg(F.count("*").alias("n_hit"))
        named = found.select("row", "item").distinct().join(names, "item").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
        marks = settled(hit.join(named, "row", "left"), "marks", stays=True)
    texts = postings.filter("n_words is not null").select("row", "doc_id", "n_words")
    out = texts.join(marks, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def matches(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 0) -> DataFrame:
    """doc_id, item_id, first_word, last_word, item_word, n_words: where windows of the items stand in the documents, as exact phrases
    (``slop`` 0) or with each term up to ``slop`` places off."""
    with passing_tables():
        postings, terms, names = indexed(docs, items, window)
        found = occurrences(postings, terms, window, slop)
        texts = postings.filter("n_words is not null").select("row", "doc_id")
        out = found.join(names, "item").join(texts, "row")
        out = settled(out.select("doc_id", "item_id", F.col("from_pos").alias("first_word"), F.col("to_pos").alias("last_word"), F.col("w").alias("item_word"), F.col("size").alias("n_words")), "matches", stays=True)
    return out
