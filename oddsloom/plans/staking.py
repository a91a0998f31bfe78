"""Stake sizing, exposure and the coupon filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ISSUES
from ..functions import odds as O
from ..functions.calendar import monday
from ..functions.staking import kelly, risk_label
from ..operators import exposure as X
from ..views import Tables
from .registry import query
from .scoring import rounded

KELLY_SQL = "CASE WHEN {o} - 1 <= 0 OR {p} * ({o} - 1) - (1 - {p}) <= 0 THEN 0 ELSE least(({p} * ({o} - 1) - (1 - {p})) / ({o} - 1) * 0.25, 0.05) END"

STAKE_SQL = f"""
f AS (SELECT match_id, league, home, away, date, CAST(date_trunc('week', date) AS DATE) AS week, fthg, odds_h, odds_d, odds_a, 1 / (odds_h + 0.1) + 1 / (odds_d - 0.7) + 1 / (odds_a + 0.2) AS b FROM matches_v WHERE odds_h IS NOT NULL),
p AS (SELECT *, unnest([{{'issue': 'home', 'odds': odds_h, 'p': 1 / (odds_h + 0.1) / b}}, {{'issue': 'draw', 'odds': odds_d, 'p': 1 / (odds_d - 0.7) / b}}, {{'issue': 'away', 'odds': odds_a, 'p': 1 / (odds_a + 0.2) / b}}]) AS x FROM f),
stakes AS (SELECT match_id, league, home, away, date, week, fthg, x.issue AS issue, x.odds AS odds, x.p AS p, {KELLY_SQL.format(o='x.odds', p='x.p')} AS stake FROM p)
"""


def stake_rows(t: Tables) -> DataFrame:
    """Positive stakes of a draw-leaning forecast at the quoted prices."""
    inv = [1.0 / (F.col("odds_h") + 0.1), 1.0 / (F.col("odds_d") - 0.7), 1.0 / (F.col("odds_a") + 0.2)]
    final = O.normalise(F.array(*inv))
    rows = t.matches.filter("odds_h IS NOT NULL").select(
        "match_id", "league", "home", "away", "date", monday(F.col("date")).alias("week"), "fthg",
        F.array("odds_h", "odds_d", "odds_a").alias("best_odds"), final.alias("final"),
    )
    return X.match_stakes(rows, ["match_id", "league", "home", "away", "date", "week", "fthg"])


@query("kelly_stakes", f"WITH {STAKE_SQL} SELECT match_id, issue, round(odds, 6) AS odds, round(stake, 6) AS stake, CASE WHEN stake < 0.01 THEN 'low' WHEN stake < 0.025 THEN 'moderate' ELSE 'high' END AS risk FROM stakes WHERE stake > 0")
def kelly_stakes(t: Tables) -> DataFrame:
    rows = stake_rows(t)
    return rows.select("match_id", "issue", F.round("odds", 6).alias("odds"), F.round("stake", 6).alias("stake"), risk_label(F.col("stake")).alias("risk"))


@query("kelly_by_price", f"""
WITH k AS (SELECT book, {KELLY_SQL.format(o='price', p='0.4')} AS s, price FROM book_odds_v)
SELECT book, count(*) AS n, count(*) FILTER (s > 0) AS n_stakes, round(sum(s), 4) AS staked, count(*) FILTER (s >= 0.05) AS n_capped FROM k GROUP BY book
""")
def kelly_by_price(t: Tables) -> DataFrame:
    s = kelly(F.lit(0.4), F.col("price"))
    return t.book_odds.groupBy("book").agg(
        F.count("*").alias("n"), F.count_if(s > 0).alias("n_stakes"), F.round(F.sum(s), 4).alias("staked"), F.count_if(s >= 0.05).alias("n_capped")
    )


# Open fixtures are the run, settled ones of the same week stand for bets placed earlier.
WEEK_SQL = f"""{STAKE_SQL},
items AS (SELECT match_id AS item_id, week, home, away, fthg IS NULL AS current, sum(stake) AS stake, count(*) AS n_bets FROM stakes WHERE stake > 0 GROUP BY ALL),
sized AS (SELECT item_id, week, home, away, current, stake * 0.05 AS stake, n_bets FROM items),
tm AS (SELECT week, item_id, unnest([home, away]) AS team FROM sized),
tied AS (SELECT DISTINCT week, item_id FROM tm WHERE (week, team) IN (SELECT (week, team) FROM tm GROUP BY week, team HAVING count(*) > 1))
"""
FACTOR_SQL = f"""{WEEK_SQL},
mk AS (SELECT s.*, t.item_id IS NOT NULL AS tie FROM sized s LEFT JOIN tied t USING (week, item_id)),
sm AS (SELECT week, coalesce(sum(stake) FILTER (current), 0) AS gross, coalesce(sum(CASE WHEN tie THEN 1.5 ELSE 1 END * stake) FILTER (current), 0) AS eff, coalesce(sum(stake) FILTER (NOT current), 0) AS prior,
  coalesce(sum(CASE WHEN tie THEN 1.5 ELSE 1 END * stake) FILTER (NOT current), 0) AS eprior, coalesce(sum(n_bets) FILTER (current), 0)::BIGINT AS n_bets, count(*) FILTER (current) AS n_matches, count(*) FILTER (current AND tie) AS n_correlated FROM mk GROUP BY week),
fc AS (SELECT *, greatest(0, 0.15 - eprior) AS budget, CASE WHEN eff <= greatest(0, 0.15 - eprior) * (1 + 1e-9) THEN 1.0 ELSE greatest(0, 0.15 - eprior) / eff END AS factor FROM sm)
"""


def week_items(t: Tables) -> DataFrame:
    items = stake_rows(t).groupBy(F.col("match_id").alias("item_id"), "week", "home", "away", F.col("fthg").isNull().alias("current")).agg(
        (F.sum("stake") * 0.05).alias("stake"), F.count("*").alias("n_bets")
    )
    return items


@query("correlated_matches", f"WITH {WEEK_SQL} SELECT week, item_id FROM tied")
def correlated_matches(t: Tables) -> DataFrame:
    return X.correlated_matches(week_items(t))


@query("exposure_cap", f"""
WITH {FACTOR_SQL}
SELECT week, round(gross, 6) AS gross, round(eff, 6) AS effective_gross, round(prior, 6) AS prior, n_bets, n_matches, n_correlated, round(budget, 6) AS budget, round(factor, 6) AS factor, round(prior + gross * factor, 6) AS total,
  CASE WHEN factor <= 0 AND n_bets > 0 THEN 'blocked' WHEN factor < 1 THEN 'reduced' WHEN prior + gross * factor > 0.15 * (1 + 1e-9) THEN 'already_above_cap' ELSE 'under_cap' END AS state FROM fc
""")
def exposure_cap(t: Tables) -> DataFrame:
    """One factor per week for the run, given what is already at stake."""
    items = week_items(t)
    out = X.exposure_factors(items.filter("current").drop("current"), items.filter("NOT current").drop("current"))
    names = ["gross", "effective_gross", "prior", "budget", "factor", "total"]
    return rounded(out.select("week", *names, "n_bets", "n_matches", "n_correlated", "state"), *names)


@query("capped_bets", f"""
WITH {FACTOR_SQL}
SELECT s.match_id, s.issue, round(s.odds, 6) AS odds, round(s.stake * f.factor, 6) AS stake_pct, CASE WHEN f.factor < 1 THEN round(s.stake, 6) END AS stake_pct_uncapped, CASE WHEN f.factor < 1 THEN round(f.factor, 6) END AS exposure_factor
FROM stakes s JOIN fc f USING (week) WHERE s.stake > 0 AND s.fthg IS NULL AND round(s.stake * f.factor, 6) > 0
""")
def capped_bets(t: Tables) -> DataFrame:
    """Final stakes of the open fixtures, as stored with each bet."""
    items = week_items(t)
    factors = X.exposure_factors(items.filter("current").drop("current"), items.filter("NOT current").drop("current"))
    final = X.final_stakes(stake_rows(t).filter("fthg IS NULL"), factors)
    listed = X.bet_lists(final, ["match_id"])
    return listed.select("match_id", F.inline("bets")).withColumn("odds", F.round("odds", 6))


@query("pending_exposure", """
SELECT CAST(date_trunc('week', date) AS DATE) AS week, round(sum(stake_pct), 6) AS prior, count(*) AS prior_bets FROM bets_v WHERE fthg IS NULL
AND (home || '-' || away, date) NOT IN (SELECT (home || '-' || away, date) FROM bets_v WHERE league = 'F1') GROUP BY 1
""")
def pending_exposure(t: Tables) -> DataFrame:
    """Open exposure per week, without the entries this run rewrites (one league's)."""
    journal = t.bets.select(
        F.concat_ws("-", "home", "away").alias("match"), "date", monday(F.col("date")).alias("week"), "league",
        F.when(F.col("fthg").isNotNull(), F.concat_ws("-", "fthg", "ftag")).alias("actual_score"), F.col("stake_pct").alias("stake"), F.lit(1).alias("n_bets"),
    )
    out = X.pending_exposure(journal, journal.filter("league = 'F1'").select("match", "date"))
    return rounded(out, "prior")


FLAGS_SQL = """
fl AS (SELECT match, bool_or(match_id % 7 = 0) AS derby, bool_or(match_id % 97 = 0) AS weather, bool_or(match_id % 89 = 0) AS euro, bool_or(match_id % 83 = 0) AS coach FROM (SELECT home || '-' || away AS match, match_id, season FROM matches_v) WHERE season < 1996 GROUP BY match),
bt AS (SELECT match_id, home || '-' || away AS match, home, away, issue, odds, stake_pct, odds_age_days FROM bets_v WHERE fthg IS NULL),
rs AS (SELECT bt.*, (CASE WHEN home IN ('E0-T3', 'F1-T9') OR away IN ('E0-T3', 'F1-T9') THEN 1 ELSE 0 END) AS low, (CASE WHEN odds_age_days >= 5 THEN 1 ELSE 0 END) AS stale, coalesce(euro, FALSE)::INT AS euro, coalesce(coach, FALSE)::INT AS coach, coalesce(weather, FALSE)::INT AS weather,
  (coalesce(derby, FALSE) AND odds > 4)::INT AS derby, fl.match IS NOT NULL AS documented FROM bt LEFT JOIN fl USING (match))
"""


def _flags(t: Tables) -> DataFrame:
    rows = t.matches.filter("season < 1996").select(F.concat_ws("-", "home", "away").alias("match"), "match_id")
    has = lambda k: F.bool_or(F.col("match_id") % k == 0)
    return rows.groupBy("match").agg(
        has(7).alias("derby"), has(97).alias("weather_extreme"), has(89).alias("post_european_home"), has(83).alias("coach_change_away")
    ).withColumns({n: F.lit(False) for n in ("post_european_away", "coach_change_home", "low_stakes_home", "low_stakes_away")})


def _open_bets(t: Tables) -> DataFrame:
    return t.bets.filter("fthg IS NULL").withColumn("match", F.concat_ws("-", "home", "away"))


@query("coupon_filter", f"""
WITH {FLAGS_SQL}
SELECT match_id, concat_ws('+', CASE WHEN low = 1 THEN 'low_history' END, CASE WHEN stale = 1 THEN 'stale_odds' END, CASE WHEN euro = 1 THEN 'rotation' END, CASE WHEN coach = 1 THEN 'coach_change' END, CASE WHEN weather = 1 THEN 'weather' END,
  CASE WHEN derby = 1 THEN 'derby_outsider' END) AS reasons, low + stale + euro + coach + weather + derby = 0 AS eligible FROM rs
""")
def coupon_filter(t: Tables) -> DataFrame:
    out = X.coupon(_open_bets(t), _flags(t), ("E0-T3", "F1-T9"))
    return out.select("match_id", F.array_join("reasons", "+").alias("reasons"), "eligible")


@query("coupon_totals", f"""
WITH {FLAGS_SQL} SELECT low + stale + euro + coach + weather + derby = 0 AS eligible, count(*) AS n, round(sum(stake_pct), 6) AS exposure FROM rs GROUP BY 1
""")
def coupon_totals(t: Tables) -> DataFrame:
    out = X.coupon(_open_bets(t), _flags(t), ("E0-T3", "F1-T9"))
    return out.groupBy("eligible").agg(F.count("*").alias("n"), F.round(F.sum("stake_pct"), 6).alias("exposure"))


@query("undocumented_matches", f"WITH {FLAGS_SQL} SELECT DISTINCT match FROM rs WHERE NOT documented")
def undocumented_matches(t: Tables) -> DataFrame:
    """Open matches with bets that no context row describes: those of the later seasons' pairings."""
    return X.undocumented(_open_bets(t), _flags(t))


@query("without_odds_summary", """
SELECT CASE WHEN match_id % 2 = 0 THEN 'lookup_failed' ELSE 'not_provided' END AS no_odds_reason, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM matches_v WHERE odds_h IS NULL GROUP BY 1
""")
def without_odds_summary(t: Tables) -> DataFrame:
    rows = t.matches.select("date", F.col("odds_h").alias("market"), F.when(F.col("match_id") % 2 == 0, "lookup_failed").otherwise("not_provided").alias("no_odds_reason"))
    return X.without_odds_summary(rows)
