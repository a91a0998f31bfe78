"""Upserts and change classification over the match views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merge
from ..views import Tables
from .registry import query

# Stored rows: seasons up to 1998, one per key. Incoming rows: seasons from 1998 on, with the
# average-close quotes moved, so the shared season holds updates and no-ops and the rest is new.
SPLIT_SQL = """
stored AS (SELECT * FROM matches_v WHERE season <= 1998 QUALIFY row_number() OVER (PARTITION BY date, home, away ORDER BY match_id) = 1),
incoming AS (SELECT match_id AS seq, date, home, away, league, season, fthg, ftag, CASE WHEN odds_source = 'avg_close' THEN odds_h + 0.5 ELSE odds_h END AS odds_h FROM matches_v WHERE season >= 1998),
last_in AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY date, home, away ORDER BY seq DESC) = 1)
"""


def _stored(t: Tables) -> DataFrame:
    return merge.first_per_key(t.matches.filter("season <= 1998"), ["date", "home", "away"], ["match_id"])


def _incoming(t: Tables) -> DataFrame:
    moved = F.when(F.col("odds_source") == "avg_close", F.col("odds_h") + 0.5).otherwise(F.col("odds_h"))
    return t.matches.filter("season >= 1998").select(
        F.col("match_id").alias("seq"), "date", "home", "away", "league", "season", "fthg", "ftag", moved.alias("odds_h")
    )


@query("match_upsert", f"""
WITH {SPLIT_SQL},
fresh AS (SELECT l.*, row_number() OVER (ORDER BY l.date, l.home, l.away) + (SELECT max(match_id) FROM stored) AS match_id FROM last_in l ANTI JOIN stored s USING (date, home, away))
SELECT s.match_id, s.date, s.home, s.away, CASE WHEN l.seq IS NULL THEN s.fthg ELSE l.fthg END AS fthg, round(CASE WHEN l.seq IS NULL THEN s.odds_h ELSE l.odds_h END, 6) AS odds_h, round(s.xg_home, 6) AS xg_home
FROM stored s LEFT JOIN last_in l USING (date, home, away)
UNION ALL SELECT match_id, date, home, away, fthg, round(odds_h, 6), NULL FROM fresh
""")
def match_upsert(t: Tables) -> DataFrame:
    """Batch columns replace stored ones, xG and ids survive, the last duplicate wins."""
    out = merge.upsert_matches(_stored(t), _incoming(t), ["seq"])
    return out.select("match_id", "date", "home", "away", "fthg", F.round("odds_h", 6).alias("odds_h"), F.round("xg_home", 6).alias("xg_home"))


@query("change_classification", f"""
WITH {SPLIT_SQL},
b AS (SELECT i.*, lag(i.seq) OVER w AS p_seq, lag(i.fthg) OVER w AS p_fthg, lag(i.ftag) OVER w AS p_ftag, lag(i.odds_h) OVER w AS p_odds, lag(i.season) OVER w AS p_season
  FROM incoming i WINDOW w AS (PARTITION BY date, home, away ORDER BY seq)),
c AS (SELECT b.league, b.season, b.date, coalesce(b.p_seq, s.match_id) AS prev,
   CASE WHEN b.p_seq IS NOT NULL THEN b.p_fthg IS NOT DISTINCT FROM b.fthg AND b.p_ftag IS NOT DISTINCT FROM b.ftag AND b.p_odds IS NOT DISTINCT FROM b.odds_h
   ELSE s.fthg IS NOT DISTINCT FROM b.fthg AND s.ftag IS NOT DISTINCT FROM b.ftag AND s.odds_h IS NOT DISTINCT FROM b.odds_h END AS same
  FROM b LEFT JOIN stored s USING (date, home, away))
SELECT league, season, count(*) AS n_read, count(*) FILTER (prev IS NULL) AS n_inserted, count(*) FILTER (prev IS NOT NULL AND NOT same) AS n_updated,
  count(*) FILTER (prev IS NOT NULL AND same) AS n_ignored, max(date) AS max_date FROM c GROUP BY league, season
""")
def change_classification(t: Tables) -> DataFrame:
    return merge.classify_changes(_stored(t), _incoming(t), ["seq"])


@query("xg_update", """
WITH x AS (SELECT date, home, away, max(xg_home) AS xh, max(xg_away) AS xa FROM xg_v GROUP BY ALL)
SELECT match_id, round(CASE WHEN x.date IS NOT NULL THEN xh ELSE xg_home END, 6) AS xg_home, round(CASE WHEN x.date IS NOT NULL THEN xa ELSE xg_away END, 6) AS xg_away, x.date IS NOT NULL AS xg_hit
FROM matches_v m LEFT JOIN x ON x.date = m.date AND x.home = m.home AND x.away = m.away
""")
def xg_update(t: Tables) -> DataFrame:
    xg = t.xg.groupBy("date", "home", "away").agg(F.max("xg_home").alias("xg_home"), F.max("xg_away").alias("xg_away"))
    out = merge.update_xg(t.matches, xg)
    return out.select("match_id", F.round("xg_home", 6).alias("xg_home"), F.round("xg_away", 6).alias("xg_away"), "xg_hit")


@query("prediction_upsert", """
SELECT match_id, 'ou25' AS market, round(CASE WHEN season >= 1999 THEN 1 / (open_h + 0.1) ELSE 1 / (open_a + 0.1) END, 6) AS model_p FROM matches_v WHERE season <= 1999
UNION ALL SELECT match_id, 'ou25', round(1 / (open_h + 0.1), 6) FROM matches_v WHERE season > 1999
UNION ALL SELECT match_id, 'btts', round(1 / (open_d + 0.1), 6) FROM matches_v WHERE season >= 1999
""")
def prediction_upsert(t: Tables) -> DataFrame:
    """Long predictions keyed by (match_id, market): season 1999 is written twice, the later write wins."""
    row = lambda m, c: F.struct(F.lit(m).alias("market"), (1.0 / (F.col(c) + 0.1)).alias("model_p"))
    old = t.matches.filter("season <= 1999").select("match_id", F.inline(F.array(row("ou25", "open_a"))))
    new = t.matches.filter("season >= 1999").select("match_id", F.inline(F.array(row("ou25", "open_h"), row("btts", "open_d"))))
    return merge.upsert(old, new, ["match_id", "market"]).withColumn("model_p", F.round("model_p", 6))


@query("snapshot_insert_or_ignore", """
SELECT fetched_at, league, home, away, book, market, outcome, point, min(price) AS price FROM book_odds_v
WHERE commence_time < TIMESTAMP '1998-01-01' GROUP BY ALL
UNION ALL
SELECT n.* FROM (SELECT fetched_at, league, home, away, book, market, outcome, point, min(price) AS price FROM book_odds_v WHERE commence_time >= TIMESTAMP '1997-12-25' GROUP BY ALL) n
ANTI JOIN (SELECT * FROM book_odds_v WHERE commence_time < TIMESTAMP '1998-01-01') o
ON n.fetched_at = o.fetched_at AND n.league = o.league AND n.home = o.home AND n.away = o.away AND n.book = o.book AND n.market = o.market AND n.outcome = o.outcome AND n.point IS NOT DISTINCT FROM o.point
""")
def snapshot_insert_or_ignore(t: Tables) -> DataFrame:
    """Append quotes to the stored ones; a quote already stored, or repeated in the batch, is ignored."""
    keys = merge.snapshot_keys()
    before = t.book_odds.filter("commence_time < TIMESTAMP '1998-01-01'")
    stored = merge.first_per_key(before, keys, ["price"])
    batch = t.book_odds.filter("commence_time >= TIMESTAMP '1997-12-25'")
    added = merge.insert_or_ignore(stored, batch, keys, ["price"])
    return stored.unionByName(added).drop("commence_time")


@query("alias_upsert", """
SELECT n_name AS alias, CASE WHEN n_regionkey <= 2 THEN 'R' || n_regionkey ELSE 'N' || n_nationkey END AS canonical FROM nation
""")
def alias_upsert(t: Tables) -> DataFrame:
    n = t.raw("nation")
    old = n.select(F.col("n_name").alias("alias"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("canonical"))
    new = n.filter("n_regionkey <= 2").select(F.col("n_name").alias("alias"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("canonical"))
    return merge.upsert(old, new, ["alias"])


@query("journal_upsert", """
WITH j AS (SELECT home || '-' || away AS match, league AS competition, season, min(date) AS d0, max(date) AS d1, min(match_id) AS first_id, max(match_id) AS last_id,
   count(*) AS n FROM matches_v WHERE fthg IS NULL GROUP BY ALL)
SELECT match, competition, season, d1 AS date, first_id AS logged, CASE WHEN first_id % 2 = 0 THEN 1.5 + (first_id % 50) / 10.0 ELSE 1.5 + (last_id % 50) / 10.0 END AS odds FROM j
UNION ALL SELECT home || '-' || away, league, season, date, match_id, 1.5 + (match_id % 50) / 10.0 FROM matches_v WHERE fthg IS NOT NULL
""")
def journal_upsert(t: Tables) -> DataFrame:
    """First log then re-run of each open fixture: date moves, first log time and taken odds stay."""
    i = F.col("match_id")
    bet = F.struct((1.5 + (i % 50) / 10.0).alias("odds"))
    rows = t.matches.select(
        F.concat_ws("-", "home", "away").alias("match"), F.col("league").alias("competition"), "season", "date", "match_id",
        F.when(F.col("fthg").isNotNull(), F.concat_ws("-", "fthg", "ftag")).alias("actual_score"), F.array(bet).alias("bets"),
        F.struct(F.lit(1.0).alias("exposure_factor"), F.lit(False).alias("correlated_exposure")).alias("meta"), i.alias("logged_at"),
    )
    key = ["match", "competition", "season"]
    open_rows = rows.filter("actual_score IS NULL")
    first = merge.first_per_key(open_rows, key, ["match_id"])
    # odd first runs carried no bet yet, so the re-run may place one
    no_bets = F.filter("bets", lambda b: F.lit(False))
    first = first.withColumn("bets", F.when(F.col("match_id") % 2 == 0, F.col("bets")).otherwise(no_bets))
    newest = open_rows.groupBy(*key).agg(F.max("date").alias("date"), F.max_by(F.struct("match_id", "actual_score", "bets", "meta", "logged_at"), "match_id").alias("r"))
    rerun = newest.select(*key, "date", "r.*")
    old = first.unionByName(rows.filter("actual_score IS NOT NULL"))
    out = merge.merge_journal(old.drop("match_id"), rerun.drop("match_id"))
    return out.select(*key, "date", F.col("logged_at").alias("logged"), F.col("bets")[0]["odds"].alias("odds"))
