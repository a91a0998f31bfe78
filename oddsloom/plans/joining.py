"""Joins of the match domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins as J
from ..views import Tables
from .registry import query

XG_HITS_SQL = """
cand AS (SELECT seq, CAST(x.date + INTERVAL '1' DAY * d.delta AS DATE) AS date, CASE WHEN d.swap THEN away ELSE home END AS home, CASE WHEN d.swap THEN home ELSE away END AS away,
   CASE WHEN d.swap THEN xg_away ELSE xg_home END AS xh, CASE WHEN d.swap THEN xg_home ELSE xg_away END AS xa, d.prio
  FROM xg_v x, (VALUES (0, FALSE, 0), (-1, FALSE, 1), (1, FALSE, 2), (-2, FALSE, 3), (2, FALSE, 4), (0, TRUE, 5), (-1, TRUE, 6), (1, TRUE, 7), (-2, TRUE, 8), (2, TRUE, 9)) d(delta, swap, prio)),
hits AS (SELECT c.* FROM cand c SEMI JOIN matches_v m ON m.date = c.date AND m.home = c.home AND m.away = c.away QUALIFY row_number() OVER (PARTITION BY seq ORDER BY prio) = 1)
"""


@query("xg_tolerance_join", f"WITH {XG_HITS_SQL} SELECT seq, date, home, away, round(xh, 6) AS xg_home, round(xa, 6) AS xg_away, prio FROM hits")
def xg_tolerance_join(t: Tables) -> DataFrame:
    """xG rows onto matches within two days, direct before swapped orientation."""
    return J.match_xg(t.matches, t.xg).withColumns({"xg_home": F.round("xg_home", 6), "xg_away": F.round("xg_away", 6)})


@query("xg_applied", f"""
WITH {XG_HITS_SQL},
last AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY date, home, away ORDER BY seq DESC) = 1)
SELECT match_id, round(CASE WHEN l.seq IS NULL THEN m.xg_home ELSE xh END, 6) AS xg_home, round(CASE WHEN l.seq IS NULL THEN m.xg_away ELSE xa END, 6) AS xg_away, l.seq IS NOT NULL AS xg_hit
FROM matches_v m LEFT JOIN last l ON l.date = m.date AND l.home = m.home AND l.away = m.away
""")
def xg_applied(t: Tables) -> DataFrame:
    out = J.apply_xg(t.matches, t.xg)
    return out.select("match_id", F.round("xg_home", 6).alias("xg_home"), F.round("xg_away", 6).alias("xg_away"), "xg_hit")


@query("xg_unmatched", """
WITH cand AS (SELECT seq, CAST(x.date + INTERVAL '1' DAY * (d.delta + 3) AS DATE) AS date, CASE WHEN d.swap THEN away ELSE home END AS home, CASE WHEN d.swap THEN home ELSE away END AS away
  FROM xg_v x, (SELECT unnest(range(-2, 3)) AS delta, s.swap FROM (VALUES (FALSE), (TRUE)) s(swap)) d)
SELECT x.seq, x.home, x.away FROM xg_v x ANTI JOIN (SELECT c.seq FROM cand c SEMI JOIN matches_v m ON m.date = c.date AND m.home = c.home AND m.away = c.away) h USING (seq)
""")
def xg_unmatched(t: Tables) -> DataFrame:
    """Rows left over when the source dates run three days ahead."""
    late = t.xg.withColumn("date", F.date_add("date", 3))
    return J.unmatched_xg(t.matches, late).select("seq", "home", "away")


@query("nearest_result", """
WITH b AS (SELECT match_id AS bet_id, league, home, away, CAST(date + INTERVAL '1' DAY * (match_id % 6 - 2) AS DATE) AS date FROM bets_v),
c AS (SELECT b.bet_id, m.match_id AS result_id, m.fthg, m.ftag, date_diff('day', b.date, m.date) AS shift,
   row_number() OVER (PARTITION BY b.bet_id ORDER BY abs(date_diff('day', b.date, m.date)), m.date, m.match_id) AS rn
  FROM b JOIN matches_v m ON m.league = b.league AND m.home = b.home AND m.away = b.away AND m.fthg IS NOT NULL AND abs(date_diff('day', b.date, m.date)) <= 2)
SELECT b.bet_id, c.result_id, c.shift, c.fthg, c.ftag FROM b LEFT JOIN c ON c.bet_id = b.bet_id AND c.rn = 1
""")
def nearest_result(t: Tables) -> DataFrame:
    moved = t.bets.select(
        F.col("match_id").alias("bet_id"), "league", "home", "away",
        F.expr("date_add(date, CAST(match_id % 6 - 2 AS INT))").alias("date"),
    )
    out = J.nearest_result(moved, t.matches, ["fthg", "ftag"])
    return out.select("bet_id", "result_id", "shift", "fthg", "ftag")


SNAP_SQL = """
live AS (SELECT *, CAST(commence_time AS DATE) AS commence_date FROM book_odds_v WHERE book = 'pinnacle' AND market = 'h2h' AND fetched_at <= commence_time),
snap AS (SELECT league, home, away, commence_date, fetched_at, max(commence_time) AS commence_time, min(price) FILTER (outcome = 'home') AS h, min(price) FILTER (outcome = 'draw') AS d, min(price) FILTER (outcome = 'away') AS a
  FROM (SELECT *, max(fetched_at) OVER (PARTITION BY league, home, away, commence_date) AS newest FROM live) WHERE fetched_at = newest GROUP BY ALL),
full_snap AS (SELECT * FROM snap WHERE h IS NOT NULL AND d IS NOT NULL AND a IS NOT NULL)
"""


def near_snap_sql(name: str, targets: str, id_col: str) -> str:
    """The snapshot of each target's meeting, kick-off a day apart at most, in SQL."""
    return f"""
{name} AS (SELECT * FROM (SELECT t.{id_col}, t.date, s.h, s.d, s.a, s.fetched_at, row_number() OVER (PARTITION BY t.{id_col} ORDER BY abs(date_diff('day', t.date, s.commence_date)), s.commence_date) AS rn
  FROM {targets} t JOIN full_snap s ON s.league = t.league AND s.home = t.home AND s.away = t.away AND abs(date_diff('day', t.date, s.commence_date)) <= 1) WHERE rn = 1)"""


@query("latest_complete_snapshot", f"WITH {SNAP_SQL} SELECT league, home, away, commence_date, fetched_at, commence_time, h AS home_odds, d AS draw_odds, a AS away_odds FROM full_snap")
def latest_complete_snapshot(t: Tables) -> DataFrame:
    return J.latest_snapshot(t.book_odds).select(
        *J.MEETING, "fetched_at", "commence_time",
        F.col("s_home").alias("home_odds"), F.col("s_draw").alias("draw_odds"), F.col("s_away").alias("away_odds"),
    )


@query("snapshot_with_date_guard", f"""
WITH {SNAP_SQL},{near_snap_sql('near', 'matches_v', 'match_id')}
SELECT match_id, h AS home_odds, greatest(0, date_diff('day', CAST(fetched_at AS DATE), date)) AS age_days FROM near
""")
def snapshot_with_date_guard(t: Tables) -> DataFrame:
    targets = t.matches.select("match_id", *J.FIXTURE, "date")
    out = J.snapshot_for(targets, J.latest_snapshot(t.book_odds), "match_id")
    return out.select("match_id", F.col("s_home").alias("home_odds"), "age_days")


@query("best_price_as_of", """
SELECT league, home, away, market, outcome, point, max(price) AS price, arg_min(book, (-price, -epoch(fetched_at), book)) AS book, arg_min(fetched_at, (-price, -epoch(fetched_at), book)) AS fetched_at
FROM book_odds_v WHERE fetched_at <= TIMESTAMP '2000-01-01' AND (market <> 'totals' OR point = 2.5) GROUP BY ALL
""")
def best_price_as_of(t: Tables) -> DataFrame:
    return J.best_prices(t.book_odds, F.lit("2000-01-01").cast("timestamp"), totals_line=2.5)


@query("predictions_with_matches", """
SELECT p.match_id, m.league, m.season, m.date, round(p.p, 6) AS model_h, m.fthg FROM (SELECT match_id, 1 / (open_h + 0.1) AS p FROM matches_v WHERE season >= 1998) p JOIN matches_v m USING (match_id)
""")
def predictions_with_matches(t: Tables) -> DataFrame:
    preds = t.matches.filter("season >= 1998").select("match_id", F.round(1.0 / (F.col("open_h") + 0.1), 6).alias("model_h"))
    return preds.join(t.matches.select("match_id", "league", "season", "date", "fthg"), "match_id")


@query("three_way_predictions", """
SELECT m.match_id, m.fthg, m.ftag, round(1 / (m.open_h + 0.1), 6) AS a_h, round(1 / (b.odds_h + 0.1), 6) AS b_h FROM matches_v m
JOIN (SELECT match_id FROM matches_v WHERE fthg IS NOT NULL) a USING (match_id) JOIN (SELECT match_id, odds_h FROM matches_v WHERE odds_h IS NOT NULL) b USING (match_id)
""")
def three_way_predictions(t: Tables) -> DataFrame:
    """Rows scored by both models: matches, first model, second model."""
    first = t.played.select("match_id", F.round(1.0 / (F.col("open_h") + 0.1), 6).alias("a_h"))
    second = t.matches.filter("odds_h IS NOT NULL").select("match_id", F.round(1.0 / (F.col("odds_h") + 0.1), 6).alias("b_h"))
    return t.matches.select("match_id", "fthg", "ftag").join(first, "match_id").join(second, "match_id")


@query("opening_lookup_misses", """
WITH o AS (SELECT date, home, away, max(open_h) AS oh FROM matches_v WHERE odds_source IS DISTINCT FROM 'pinnacle_open' GROUP BY ALL)
SELECT m.league, count(*) AS n, count(*) FILTER (m.odds_h IS NULL) AS n_no_close, count(*) FILTER (m.odds_h IS NOT NULL AND oh IS NULL) AS n_no_open,
  count(*) FILTER (m.odds_h IS NOT NULL AND oh IS NOT NULL) AS n_both, round(avg(m.odds_h - oh), 6) AS mean_move
FROM matches_v m LEFT JOIN o USING (date, home, away) WHERE m.fthg IS NOT NULL GROUP BY m.league
""")
def opening_lookup_misses(t: Tables) -> DataFrame:
    """Opening odds by (date, home, away), and why rows drop out."""
    opening = t.matches.filter("odds_source IS DISTINCT FROM 'pinnacle_open'").groupBy("date", "home", "away").agg(F.max("open_h").alias("oh"))
    rows = t.played.select("league", "date", "home", "away", "odds_h").join(opening, ["date", "home", "away"], "left")
    closed, opened = F.col("odds_h").isNotNull(), F.col("oh").isNotNull()
    return rows.groupBy("league").agg(
        F.count("*").alias("n"), F.count_if(~closed).alias("n_no_close"), F.count_if(closed & ~opened).alias("n_no_open"),
        F.count_if(closed & opened).alias("n_both"), F.round(F.avg(F.col("odds_h") - F.col("oh")), 6).alias("mean_move"),
    )


# every team of the views plays every season: let each sit out one season in seven
SQUAD_SQL = """
sq AS (SELECT * FROM matches_v WHERE (CAST(split_part(home, '-T', 2) AS INT) + season) % 7 <> 0 AND (CAST(split_part(away, '-T', 2) AS INT) + season) % 7 <> 0),
squads AS (SELECT DISTINCT league, season, unnest([home, away]) AS team FROM sq),
pairs_of AS (SELECT league, season, lag(season) OVER (PARTITION BY league ORDER BY season) AS prev FROM (SELECT DISTINCT league, season FROM squads)),
promoted AS (SELECT s.league, s.season, s.team FROM squads s JOIN pairs_of p USING (league, season) WHERE p.prev IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM squads b WHERE b.league = s.league AND b.season = p.prev AND b.team = s.team))
"""


def squad_matches(t: Tables) -> DataFrame:
    plays = lambda side: (F.split_part(side, F.lit("-T"), F.lit(2)).cast("int") + F.col("season")) % 7 != 0
    return t.matches.filter(plays(F.col("home")) & plays(F.col("away")))


@query("promoted_teams", f"WITH {SQUAD_SQL} SELECT league, season, team FROM promoted")
def promoted_teams(t: Tables) -> DataFrame:
    """Newcomers against the season before, each team sitting out one season in seven."""
    return J.promoted(squad_matches(t))


@query("stacking_left_join", """
SELECT m.match_id, round(s.p, 6) AS dc_prob_h FROM matches_v m LEFT JOIN (SELECT match_id, 1 / (open_h + 0.1) AS p FROM matches_v WHERE season > 1994) s USING (match_id) WHERE m.fthg IS NOT NULL
""")
def stacking_left_join(t: Tables) -> DataFrame:
    """Features gain stacked probabilities; the first season has none."""
    stack = t.matches.filter("season > 1994").select("match_id", F.round(1.0 / (F.col("open_h") + 0.1), 6).alias("dc_prob_h"))
    return t.played.select("match_id").join(stack, "match_id", "left")


@query("expected_versus_actual", """
WITH seasons AS (SELECT DISTINCT season FROM matches_v), e AS (SELECT l.league, s.season, 380 AS expected FROM (VALUES ('E0'), ('SP1'), ('F1'), ('N1')) l(league), seasons s),
a AS (SELECT league, season, count(*) AS n FROM matches_v GROUP BY ALL)
SELECT e.league, e.season, e.expected, coalesce(a.n, 0) AS n, coalesce(a.n, 0) - e.expected AS gap FROM e LEFT JOIN a USING (league, season)
""")
def expected_versus_actual(t: Tables) -> DataFrame:
    leagues = F.explode(F.array(*[F.lit(x) for x in ("E0", "SP1", "F1", "N1")])).alias("league")
    expected = t.matches.select("season").distinct().select(leagues, "season", F.lit(380).alias("expected"))
    actual = t.matches.groupBy("league", "season").agg(F.count("*").alias("n"))
    joined = expected.join(actual, ["league", "season"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.withColumn("gap", F.col("n") - F.col("expected"))
