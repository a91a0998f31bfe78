"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bitplanes, decontaminate, exact_dedup, fuzzy_lines, jaccard_join, language_crf, mixing, ngram_trie, packing, phrases, quality,
    resampling, warc,
)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_pack_binary_lengths")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing by power-of-two decomposition at 1024 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), context=1024)
    return pieces.select(
        "doc_id", "start", "length", packing.digest(F.col("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id",
        "offset", "bucket",
    )


@query("op5_bloom_exact_dedup", oracle="""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t),
    k AS (SELECT d.*, keep_id, group_size,
                 row_number() OVER (PARTITION BY d.t ORDER BY doc_id DESC, r) AS n FROM d JOIN g USING (t))
    SELECT doc_id, keep_id, group_size, n = 1 AS kept, sha256(t) AS text_sha256 FROM k
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact deduplication behind a two-pass Bloom filter."""
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


@query("op6_line_first_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first quality rules."""
    return quality.judge(table(spark, sf_dir, "documents"))


@query("op8_warc_seekable_bundles", oracle="""
    WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
    k AS (SELECT h, max(page_id) AS keep FROM p WHERE n >= 1000 GROUP BY h)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
      CASE WHEN keep IS NULL OR keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN keep <> page_id THEN keep END AS refers_to
    FROM p LEFT JOIN k ON k.h = p.h AND n >= 1000
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC records written to seekable Zstandard bundles and read back through their index."""
    records = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_bit_plane_ids")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as compressed byte planes and read back."""
    back = bitplanes.round_trip(spark, table(spark, sf_dir, "documents"))
    return back.select("doc_id", "start", "n_tokens", packing.digest(F.col("ids")).alias("ids_crc32"))


@query("op3_prefix_jaccard_join", oracle="""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
    SELECT r.node AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their four-word shingles."""
    return jaccard_join.linked_components(table(spark, sf_dir, "documents"), k=4, percent=85)


@query("op2_elias_fano_trie_lm")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of whole texts by an Elias-Fano n-gram trie."""
    return ngram_trie.learn_and_score(table(spark, sf_dir, "documents"))


@query("op9_crf_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of whole texts by a conditional random field over words."""
    return language_crf.learn_and_predict(table(spark, sf_dir, "documents"))


@query("op4_pfair_mix")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scheduled by source: shares in proportion to the root of a source's characters."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        F.col("doc.doc_id").alias("doc_id"), "src", "share", "block", "slot", "release", "deadline", "before")


@query("op7_fuzzy_line_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with the line that stays for its class of near copies."""
    return fuzzy_lines.line_classes(table(spark, sf_dir, "documents"))


@query("op11_trie_phrase_collocations", oracle="""
    WITH p AS (SELECT row_number() OVER () AS id, lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS t
        FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
    w AS (SELECT lang, regexp_extract_all(t, '[^\\x20\\x09]+') AS w FROM p),
    n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
    g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 5)) AS m) WHERE len(w) >= m),
    f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
    c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
    k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
    s AS (SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score
        FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(ws[1 : k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(ws[k + 1 :], ' ')),
    b AS (SELECT lang, phrase, a, arg_min({'l': l, 'r': r, 'score': score}, score * 8 + k) AS v FROM s GROUP BY ALL),
    i AS (SELECT lang, array_to_string(ws[i : i + q - 1], ' ') AS phrase, max(a) AS above FROM (SELECT *, unnest(range(1, m - q + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS q FROM c)) GROUP BY ALL),
    z AS (SELECT b.lang, b.phrase, a, v.l AS l, v.r AS r, v.score AS score FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE above IS NULL OR 100::HUGEINT * above < 80::HUGEINT * a),
    o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
    SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language, by double-array tries of Apriori-safe candidates."""
    return phrases.collocations(table(spark, sf_dir, "documents"), least=30, closed_percent=80, top=2000)


WORDS_SQL = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""


@query("op12_positional_index_decontamination", oracle=f"""
    WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, {WORDS_SQL} AS w FROM documents),
    dw AS (SELECT r, unnest(w) AS t, unnest(range(len(w))) AS p FROM d),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, row_number() OVER (ORDER BY item_id) AS i, {WORDS_SQL} AS w FROM benchmark),
    x AS (SELECT i, item_id, least(10, len(w)) AS size, unnest(range(greatest(len(w) - 9, 1))) AS s, w FROM b WHERE len(w) > 0),
    v AS (SELECT i, item_id, size, s, w[s + 1 : s + size] AS g FROM x),
    k AS (SELECT DISTINCT size FROM v),
    h AS (SELECT r, size, p AS s, w[p + 1 : p + size] AS g FROM (SELECT r, w, size, unnest(range(len(w) - size + 1)) AS p FROM d, k WHERE len(w) >= size)),
    m AS (SELECT h.r, h.s, v.size, v.item_id FROM h JOIN v ON h.size = v.size AND h.g = v.g),
    hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS p FROM m) GROUP BY r),
    it AS (SELECT r, list_sort(list(DISTINCT item_id)) AS items FROM m GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
      sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in ten-word windows of benchmark items, by a positional inverted index."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


# crc32 by a table of 256 remainders, byte by byte; the table comes from the polynomial
@query("op13_quickselect_importance_resampling", oracle=f"""
    WITH c AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)),
    d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, {WORDS_SQL} AS w FROM documents),
    b AS (SELECT {WORDS_SQL} AS w FROM benchmark),
    df AS (SELECT r, unnest(w) AS f FROM d UNION ALL SELECT r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d),
    bf AS (SELECT unnest(w) AS f FROM b UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM b),
    u AS (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)),
    x AS (SELECT f, hex(encode(f)) AS h FROM u),
    k AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
        lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM x, c),
    s AS (SELECT bucket, count(*) AS n FROM df JOIN k USING (f) GROUP BY bucket),
    q AS (SELECT bucket, count(*) AS n FROM bf JOIN k USING (f) GROUP BY bucket),
    g AS (SELECT a.bucket, CAST(floor(1000 * ln(CAST((coalesce(q.n, 0) + 1) * ((SELECT count(*) FROM df) + 10000) AS DOUBLE) / ((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM bf) + 10000)))) AS BIGINT) AS gain
        FROM (SELECT unnest(range(10000)) AS bucket) a LEFT JOIN s USING (bucket) LEFT JOIN q USING (bucket)),
    z AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY r),
    e AS (SELECT doc_id, r, len(w) AS words, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
        CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN z USING (r)),
    o AS (SELECT *, CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM e),
    p AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS rank FROM o WHERE words >= 20)
    SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score,
      CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM p) THEN rank END AS rank
    FROM o LEFT JOIN p USING (r)
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents with twenty words or more, drawn towards the distribution of the benchmark."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), grams=2, buckets=10000, least_words=20, percent=25, seed=7)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents, without the ids."""
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, sf_dir)
    return pieces.withColumn("ids_crc32", packing.digest(F.col("ids"))).drop("ids")
