"""Data-quality checks over the match views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import TOP_LEAGUES
from ..operators import quality as Q
from ..views import Tables
from .registry import query
from .scoring import rounded


def expected_counts(t: Tables) -> DataFrame:
    """380 rows per league and season of the bundled views, 306 for F1 from 1998 on."""
    leagues = F.explode(F.array(*[F.lit(x) for x in TOP_LEAGUES])).alias("league")
    n = F.when((F.col("league") == "F1") & (F.col("season") >= 1998), 306).otherwise(380)
    return t.matches.select("season").distinct().select(leagues, "season").withColumn("expected", n)


@query("count_check", """
WITH e AS (SELECT l.league, s.season, CASE WHEN l.league = 'F1' AND s.season >= 1998 THEN 306 ELSE 380 END AS expected FROM (VALUES ('E0'), ('SP1'), ('F1')) l(league), (SELECT DISTINCT season FROM matches_v) s),
a AS (SELECT league, season, count(*) AS n FROM matches_v GROUP BY ALL)
SELECT league, season, expected, coalesce(n, 0) AS n, coalesce(n, 0) - expected AS gap, CASE WHEN season = 2001 THEN 'running' WHEN coalesce(n, 0) = expected THEN 'ok' ELSE 'off' END AS status FROM e LEFT JOIN a USING (league, season)
""")
def count_check(t: Tables) -> DataFrame:
    return Q.count_check(t.matches, expected_counts(t), 2001)


@query("duplicate_keys", "SELECT date, home, away, count(*) AS n FROM matches_v GROUP BY date, home, away HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return Q.duplicate_keys(t.matches)


@query("closing_odds_share", """
SELECT league, season, count(*) AS n, round(100.0 * avg((coalesce(odds_source, '') IN ('pinnacle_close', 'avg_close'))::INT), 6) AS closing_pct, round(100.0 * avg((odds_h IS NOT NULL)::INT), 6) AS any_pct,
  CASE WHEN season < 1996 THEN 100.0 * avg((odds_h IS NOT NULL)::INT) ELSE 100.0 * avg((coalesce(odds_source, '') IN ('pinnacle_close', 'avg_close'))::INT) END >= 99 AS passed
FROM matches_v WHERE league IN ('E0', 'SP1', 'F1') GROUP BY league, season
""")
def closing_odds_share(t: Tables) -> DataFrame:
    return rounded(Q.closing_share(t.matches, TOP_LEAGUES, 1996), "closing_pct", "any_pct")


@query("column_completeness", """
SELECT league, season, count(*) AS n, round(100.0 * count(odds_h) / count(*), 6) AS odds_h, round(100.0 * count(ah_line) / count(*), 6) AS ah_line, round(100.0 * count(xg_home) / count(*), 6) AS xg_home,
  round(100.0 * count(fthg) / count(*), 6) AS fthg FROM matches_v GROUP BY league, season
""")
def column_completeness(t: Tables) -> DataFrame:
    return rounded(Q.completeness(t.matches), "odds_h", "ah_line", "xg_home", "fthg")


@query("xg_coverage", """
SELECT league, season, count(*) AS n, count(*) - count(xg_home) AS n_missing, round(100.0 * count(xg_home) / count(*), 6) AS pct, 100.0 * count(xg_home) / count(*) >= 95 OR season = 2001 AS passed
FROM matches_v WHERE fthg IS NOT NULL GROUP BY league, season
""")
def xg_coverage(t: Tables) -> DataFrame:
    return rounded(Q.xg_coverage(t.matches, TOP_LEAGUES, 2001), "pct")


@query("teams_missing_xg", """
SELECT team, count(*) AS n FROM (SELECT unnest([home, away]) AS team FROM matches_v WHERE fthg IS NOT NULL AND xg_home IS NULL) GROUP BY team ORDER BY n DESC, team LIMIT 15
""")
def teams_missing_xg(t: Tables) -> DataFrame:
    return Q.teams_missing_xg(t.matches)


@query("first_missing_xg", "SELECT date, match_id, league, home, away FROM matches_v WHERE fthg IS NOT NULL AND xg_home IS NULL ORDER BY date, match_id LIMIT 20")
def first_missing_xg(t: Tables) -> DataFrame:
    return Q.first_missing_xg(t.matches)


@query("secondary_league_table", """
SELECT league, season, count(*) AS n, count(fthg) AS n_played, round(coalesce(100.0 * count(*) FILTER (odds_source IN ('pinnacle_close', 'avg_close')) / nullif(count(fthg), 0), 0), 6) AS closing_pct FROM matches_v WHERE league IN ('F1', 'N1') GROUP BY league, season
""")
def secondary_league_table(t: Tables) -> DataFrame:
    return rounded(Q.secondary_table(t.matches, ("F1", "N1")), "closing_pct")


@query("stagnation_guard", """
WITH d AS (SELECT DISTINCT league, date FROM matches_v WHERE season = 1999), g AS (SELECT league, max(gap) AS g FROM (SELECT league, date_diff('day', lag(date) OVER (PARTITION BY league ORDER BY date), date) AS gap FROM d) GROUP BY league),
a AS (SELECT league, max(date) AS max_date, count(*) AS n FROM matches_v WHERE season = 2000 GROUP BY league), b AS (SELECT league, max(date) AS before FROM matches_v WHERE season = 2000 AND fthg IS NOT NULL GROUP BY league)
SELECT a.league, max_date, date_diff('day', max_date, DATE '2001-08-01') AS days, greatest(5, coalesce(g, 0)) AS threshold, max_date IS NOT DISTINCT FROM before AND a.n < 1000000 AND date_diff('day', max_date, DATE '2001-08-01') > greatest(5, coalesce(g, 0)) AS stagnant
FROM a LEFT JOIN b USING (league) LEFT JOIN g USING (league)
""")
def stagnation_guard(t: Tables) -> DataFrame:
    """State before the run: played rows only; after: all rows."""
    expected = expected_counts(t).withColumn("expected", F.lit(1_000_000))
    return Q.stagnation(t.played, t.matches, expected, 2000, 1999, "2001-08-01")


@query("calendar_coverage", """
SELECT max(season) AS newest, bool_or(season = 2002) AS present, 2002 AS expected, max(season) = 2002 AS is_current FROM matches_v
""")
def calendar_coverage(t: Tables) -> DataFrame:
    return Q.calendar_coverage(t.matches.select("season").distinct(), F.lit("2002-07-15").cast("date"))
