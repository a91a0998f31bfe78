"""File sources: result CSVs, xG JSON, odds snapshots, and the semi-structured logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.calendar import mixed_date
from ..functions.cleaning import first_complete, first_quoted, number

# season and league in the file (or folder) name, e.g. 2324_E0.csv
PATH_PATTERN = r"(\d{4})_([A-Za-z0-9]+?)(?:\.csv|/)"
COMMA_OUTSIDE_QUOTES = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'

XG_SCHEMA = T.StructType([
    T.StructField("isResult", T.BooleanType()),
    T.StructField("datetime", T.StringType()),
    T.StructField("h", T.StructType([T.StructField("title", T.StringType())])),
    T.StructField("a", T.StructType([T.StructField("title", T.StringType())])),
    T.StructField("xG", T.StructType([T.StructField("h", T.StringType()), T.StructField("a", T.StringType())])),
])
_OUTCOME = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("price", T.DoubleType()),
    T.StructField("point", T.DoubleType()),
])
_MARKET = T.StructType([T.StructField("key", T.StringType()), T.StructField("outcomes", T.ArrayType(_OUTCOME))])
_BOOKMAKER = T.StructType([T.StructField("key", T.StringType()), T.StructField("markets", T.ArrayType(_MARKET))])
SNAPSHOT_SCHEMA = T.StructType([
    T.StructField("fetched_at", T.TimestampType()), T.StructField("league", T.StringType()),
    T.StructField("commence_time", T.TimestampType()), T.StructField("home_team", T.StringType()),
    T.StructField("away_team", T.StringType()), T.StructField("bookmakers", T.ArrayType(_BOOKMAKER)),
])
_PROBS = T.StructType([T.StructField(i, T.DoubleType()) for i in K.ISSUES])
BET_FIELDS = T.StructType([
    T.StructField("issue", T.StringType()), T.StructField("odds", T.DoubleType()),
    T.StructField("stake_pct", T.DoubleType()), T.StructField("stake_pct_uncapped", T.DoubleType()),
    T.StructField("exposure_factor", T.DoubleType()), T.StructField("realized_pct", T.DoubleType()),
    T.StructField("clv_pct", T.DoubleType()), T.StructField("clv_skipped", T.StringType()),
    T.StructField("clv_pct_provisional", T.DoubleType()),
])
JOURNAL_SCHEMA = T.StructType([
    T.StructField("match", T.StringType()), T.StructField("date", T.DateType()),
    T.StructField("competition", T.StringType()), T.StructField("probs", _PROBS),
    T.StructField("market_probs", _PROBS), T.StructField("predicted_score", T.StringType()),
    T.StructField("bets", T.ArrayType(BET_FIELDS)), T.StructField("actual_score", T.StringType()),
    T.StructField("actual_ht", T.StringType()), T.StructField("logged_at", T.TimestampType()),
    T.StructField("meta", T.StructType([
        T.StructField("home", T.StringType()), T.StructField("away", T.StringType()),
        T.StructField("market_weight", T.DoubleType()), T.StructField("odds_age_days", T.IntegerType()),
        T.StructField("exposure_factor", T.DoubleType()), T.StructField("correlated_exposure", T.BooleanType()),
        T.StructField("no_odds_reason", T.StringType()),
    ])),
])
REAL_BETS_SCHEMA = T.StructType([
    T.StructField("date_placed", T.StringType()), T.StructField("match", T.StringType()),
    T.StructField("competition", T.StringType()), T.StructField("issue", T.StringType()),
    T.StructField("journal_odds", T.DoubleType()), T.StructField("taken_odds", T.DoubleType()),
    T.StructField("stake", T.DoubleType()), T.StructField("result", T.StringType()),
    T.StructField("notes", T.StringType()),
])
FLAG_NAMES = (
    "post_european_home", "post_european_away", "derby", "coach_change_home", "coach_change_away",
    "weather_extreme", "low_stakes_home", "low_stakes_away",
)
FLAGS_SCHEMA = T.StructType(
    [T.StructField("match", T.StringType()), T.StructField("date", T.StringType())]
    + [T.StructField(n, T.BooleanType()) for n in FLAG_NAMES]
    + [T.StructField("notes", T.StringType())]
)


def result_cells(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Every data line of a folder of result CSVs: its cells, where each of ``names`` stands in them, season and league.

    Seasons differ in their columns, so places are those of each line's own file (NULL for a column that the file doesn't
    have), found once a file. Lines with more fields than the header are skipped, the missing cells of shorter ones are NULL.
    """
    lines = spark.read.csv(
        path, schema="line string", sep="\u0001", quote="", encoding="ISO-8859-1", recursiveFileLookup=True
    ).select(F.col("_metadata.file_path").alias("file"), "line")
    plain = F.split("line", ",")
    quoted = F.transform(F.split("line", COMMA_OUTSIDE_QUOTES), lambda v: F.btrim(v, F.lit('"')))
    parts = F.transform(F.when(F.col("line").contains('"'), quoted).otherwise(plain), lambda v: F.trim(v))
    # a line without the text HomeTeam can't have such a cell: it needn't be split to know
    cells = lines.withColumn("cells", parts).withColumn(
        "is_header", F.col("line").contains("HomeTeam") & F.array_contains("cells", "HomeTeam") & F.array_contains("cells", "Date")
    )
    headers = cells.filter("is_header").groupBy("file").agg(F.max("cells").alias("header"))
    named = F.filter("header", lambda h: h != "")
    twice = F.raise_error(F.concat(F.lit("column listed twice in the header of "), F.col("file"))).cast("int")
    at = F.struct(*[(F.nullif(F.array_position("header", n), F.lit(0)) - 1).cast("int").alias(n) for n in names])
    places = headers.select(
        "file", F.when(F.size(named) == F.size(F.array_distinct(named)), F.size("header")).otherwise(twice).alias("width"), at.alias("at"))
    # one row for each file
    body = cells.filter("NOT is_header").join(F.broadcast(places), "file").filter(F.size("cells") <= F.col("width"))
    return body.select(
        F.regexp_extract("file", PATH_PATTERN, 1).alias("season"),
        F.regexp_extract("file", PATH_PATTERN, 2).alias("league"),
        "cells", "at",
    )


def _text(name: str) -> Column:
    return F.nullif(F.get("cells", F.col("at").getField(name)), F.lit(""))


FIXTURE_CELLS = ("Date", "HomeTeam", "AwayTeam")


def _result_rows(spark: SparkSession, path: str, numbers: Sequence[str]) -> DataFrame:
    """Lines with a date and both teams: season, league, those three texts and ``numbers``, each cell parsed once."""
    numbers = list(dict.fromkeys(numbers))
    cells = result_cells(spark, path, [*FIXTURE_CELLS, *numbers])
    rows = cells.select("season", "league", *[_text(n).alias(n) for n in FIXTURE_CELLS], *[number(_text(n)).alias(n) for n in numbers])
    return rows.dropna(subset=list(FIXTURE_CELLS))


def _fixture() -> list[Column]:
    return [mixed_date(F.col("Date")).alias("date"), F.col("HomeTeam").alias("home"), F.col("AwayTeam").alias("away")]


GOAL_COLUMNS = {"fthg": "FTHG", "ftag": "FTAG", "hthg": "HTHG", "htag": "HTAG"}


def scan_results(spark: SparkSession, path: str) -> DataFrame:
    """Typed match rows of a folder of result CSVs, one odds block picked per row."""
    numbers = [
        *[c for cols, _ in K.ODDS_1X2_CHAIN for c in cols], *[c for pair in (*K.ODDS_TOTAL_CHAIN, *K.ODDS_HANDICAP_CHAIN) for c in pair],
        *K.HANDICAP_LINE_CHAIN, *GOAL_COLUMNS.values(), *K.STAT_COLUMNS.values(),
    ]
    cols = lambda names: [F.col(f"`{n}`") for n in names]
    odds = first_complete(
        [cols(c) for c, _ in K.ODDS_1X2_CHAIN], ["h", "d", "a"], [source for _, source in K.ODDS_1X2_CHAIN],
    )
    totals = first_complete([cols(pair) for pair in K.ODDS_TOTAL_CHAIN], ["over", "under"])
    handicap = first_complete([cols(pair) for pair in K.ODDS_HANDICAP_CHAIN], ["home", "away"])
    line = F.coalesce(*cols(K.HANDICAP_LINE_CHAIN))
    goals = [F.col(src).cast("int").alias(dst) for dst, src in GOAL_COLUMNS.items()]
    stats = [F.col(src).alias(dst) for dst, src in K.STAT_COLUMNS.items()]
    picked = _result_rows(spark, path, numbers).select(
        *_fixture(), "league", "season", *goals, odds.alias("o"), totals.alias("t"), line.alias("ah_line"),
        handicap.alias("x"), *stats,
    )
    return picked.select(
        "date", "league", "season", "home", "away", "fthg", "ftag", "hthg", "htag",
        F.col("o.h").alias("odds_h"), F.col("o.d").alias("odds_d"), F.col("o.a").alias("odds_a"),
        F.col("o.source").alias("odds_source"), F.col("t.over").alias("ou25_over"),
        F.col("t.under").alias("ou25_under"), "ah_line", F.col("x.home").alias("ah_home"),
        F.col("x.away").alias("ah_away"), *K.STAT_COLUMNS,
    )


def scan_opening_odds(spark: SparkSession, path: str) -> DataFrame:
    """(date, home, away, open_h/d/a): first opening triple without blanks or zeros.

    A fixture listed twice keeps the row of the later season file, then the larger triple.
    """
    opening = first_quoted([[F.col(c) for c in cols] for cols in K.OPENING_CHAIN], ["h", "d", "a"])
    read = _result_rows(spark, path, [c for cols in K.OPENING_CHAIN for c in cols])
    rows = read.select(*_fixture(), "season", opening.alias("o")).filter("o IS NOT NULL")
    last = rows.groupBy("date", "home", "away").agg(F.max_by("o", F.struct("season", "o")).alias("o"))
    return last.select(
        "date", "home", "away", F.col("o.h").alias("open_h"), F.col("o.d").alias("open_d"), F.col("o.a").alias("open_a")
    )


def scan_xg(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Played fixtures with both xG values."""
    raw = spark.read.schema(XG_SCHEMA).json(path, multiLine=multiline)
    return raw.filter("isResult AND xG.h IS NOT NULL AND xG.a IS NOT NULL").select(
        F.substring("datetime", 1, 10).cast("date").alias("date"),
        F.col("h.title").alias("home"), F.col("a.title").alias("away"),
        number(F.col("xG.h")).alias("xg_home"), number(F.col("xG.a")).alias("xg_away"),
    )


def flatten_snapshot(events: DataFrame) -> DataFrame:
    """Nested odds events to one row per price; head-to-head names become home, draw, away."""
    books = events.select("fetched_at", "league", "commence_time", "home_team", "away_team", F.explode("bookmakers").alias("b"))
    markets = books.select("*", F.col("b.key").alias("book"), F.explode("b.markets").alias("m"))
    prices = markets.select("*", F.col("m.key").alias("market"), F.explode("m.outcomes").alias("o"))
    h2h = F.col("market") == "h2h"
    side = (
        F.when(F.col("o.name") == F.col("home_team"), "home")
        .when(F.col("o.name") == F.col("away_team"), "away")
        .otherwise("draw")
    )
    return prices.select(
        "fetched_at", "league", "commence_time", F.col("home_team").alias("home"), F.col("away_team").alias("away"),
        "book", "market", F.when(h2h, side).otherwise(F.col("o.name")).alias("outcome"),
        F.when(~h2h, F.col("o.point")).alias("point"), F.col("o.price").alias("price"),
    )


def scan_snapshots(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    return flatten_snapshot(spark.read.schema(SNAPSHOT_SCHEMA).json(path, multiLine=multiline))


def _optional_json(spark: SparkSession, path: str, schema: T.StructType, multiline: bool) -> DataFrame:
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)
    if not exists:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=multiline)


def load_journal(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Production journal; a missing file is an empty journal."""
    return _optional_json(spark, path, JOURNAL_SCHEMA, multiline)


def load_real_bets(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    return _optional_json(spark, path, REAL_BETS_SCHEMA, multiline)


def load_context_flags(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """One row per match; rows without a match are dropped, the later date wins a duplicate."""
    rows = _optional_json(spark, path, FLAGS_SCHEMA, multiline).filter("match IS NOT NULL AND match <> ''")
    rest = [c for c in rows.columns if c != "match"]
    return rows.groupBy("match").agg(F.max(F.struct(*rest)).alias("r")).select("match", "r.*")
