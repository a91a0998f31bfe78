"""Settlement, closing-line value and monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SEED
from ..functions.outcomes import argmax
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import settle as S
from ..views import Tables
from .joining import SNAP_SQL, near_snap_sql
from .registry import query
from .resampling import B, PAIRS, draws_sql, ranked_sql
from .scoring import FORECAST_SQL, market_forecasts, rounded

BET_FIELDS = ("realized_pct", "clv_pct", "clv_pct_provisional")


def journal(t: Tables) -> DataFrame:
    """Journal entries of every match: one bet, result, closing block and provisional snapshot."""
    none = lambda n: F.lit(None).cast("double").alias(n)
    bet = F.struct(
        "issue", "odds", "stake_pct", *[none(n) for n in BET_FIELDS], F.lit(None).cast("string").alias("clv_skipped")
    )
    closing = F.when(F.col("odds_h").isNotNull(), F.struct(
        F.col("odds_h").alias("home"), F.col("odds_d").alias("draw"), F.col("odds_a").alias("away"), F.col("odds_source").alias("source")
    ))
    issue = F.element_at(F.array(F.lit("home"), F.lit("draw"), F.lit("away")), (F.col("match_id") % 3 + 1).cast("int"))
    rows = t.matches.withColumns({
        "issue": issue, "odds": 1.5 + (F.col("match_id") % 50) / 10.0, "stake_pct": 0.005 + 0.001 * (F.col("match_id") % 40),
    })
    prices = F.struct(F.col("s_home").alias("home"), F.col("s_draw").alias("draw"), F.col("s_away").alias("away"))
    snaps = J.snapshot_for(t.matches, J.latest_snapshot(t.book_odds), "match_id").select("match_id", prices.alias("provisional"))
    return rows.select(
        "match_id", *J.FIXTURE, "date", F.array(bet).alias("bets"), closing.alias("closing"),
        F.when(F.col("fthg").isNotNull(), F.concat_ws("-", "fthg", "ftag")).alias("actual_score"),
    ).join(snaps, "match_id", "left")


def settled_bets(t: Tables) -> DataFrame:
    return S.flat_bets(S.settle_bets(journal(t)), ["match_id", "league", "date"])


BETS_SQL = f"""{SNAP_SQL},{near_snap_sql('near', 'matches_v', 'match_id')},
bt AS (SELECT m.match_id, m.league, m.date, ['home', 'draw', 'away'][m.match_id % 3 + 1] AS issue, 1.5 + (m.match_id % 50) / 10.0 AS odds, 0.005 + 0.001 * (m.match_id % 40) AS stake_pct, m.fthg, m.ftag, m.odds_source,
   [m.odds_h, m.odds_d, m.odds_a][m.match_id % 3 + 1] AS close, [s.h, s.d, s.a][m.match_id % 3 + 1] AS snap, CASE WHEN m.fthg > m.ftag THEN 'home' WHEN m.fthg = m.ftag THEN 'draw' WHEN m.fthg < m.ftag THEN 'away' END AS winner
  FROM matches_v m LEFT JOIN near s ON s.match_id = m.match_id),
st AS (SELECT match_id, league, date, issue, odds, stake_pct, CASE WHEN winner IS NULL THEN NULL WHEN issue = winner THEN round(stake_pct * (odds - 1), 6) ELSE round(-stake_pct, 6) END AS realized_pct,
   CASE WHEN winner IS NOT NULL AND odds_source = 'pinnacle_close' THEN round(odds / close - 1, 6) END AS clv_pct,
   CASE WHEN winner IS NULL OR (odds_source = 'pinnacle_close' AND close IS NOT NULL) THEN NULL WHEN close IS NULL THEN 'no_closing_odds' ELSE 'source_not_sharp' END AS clv_skipped,
   CASE WHEN winner IS NOT NULL THEN round(odds / snap - 1, 6) END AS clv_pct_provisional FROM bt)
"""


@query("settled_bets", f"WITH {BETS_SQL} SELECT match_id, issue, realized_pct, clv_pct, clv_skipped, clv_pct_provisional FROM st")
def settle_all(t: Tables) -> DataFrame:
    """P&L, closing-line value or skip reason, and provisional value of every bet."""
    return settled_bets(t).select("match_id", "issue", *BET_FIELDS, "clv_skipped")


@query("settle_twice", f"WITH {BETS_SQL} SELECT match_id, realized_pct, clv_pct FROM st")
def settle_twice(t: Tables) -> DataFrame:
    """Settling again with other closing odds changes nothing that is already filled."""
    once = S.settle_bets(journal(t))
    moved = once.withColumn("closing", F.when(F.col("closing.source") == "pinnacle_close", F.struct(
        *[(F.col(f"closing.{s}") * 2.0).alias(s) for s in ("home", "draw", "away")], F.col("closing.source").alias("source")
    )).otherwise(F.col("closing")))
    return S.flat_bets(S.settle_bets(moved), ["match_id"]).select("match_id", "realized_pct", "clv_pct")


@query("roi_by_league", f"""
WITH {BETS_SQL} SELECT league, count(*) AS n, round(sum(stake_pct), 6) AS staked, round(sum(realized_pct), 6) AS pnl, round(sum(realized_pct) * 100 / sum(stake_pct), 6) AS roi_pct, count(*) < 100 AS small_sample FROM st WHERE realized_pct IS NOT NULL GROUP BY league
""")
def roi_by_league(t: Tables) -> DataFrame:
    return rounded(S.roi_summary(settled_bets(t), ["league"]), "staked", "pnl", "roi_pct")


def _clv_sql(col: str) -> str:
    return f"""
WITH {BETS_SQL}, cv AS (SELECT match_id, {col} AS v FROM st WHERE {col} IS NOT NULL),{ranked_sql('rb', 'cv', 'v')},{draws_sql('m', 'rb', ['v'], SEED)},
q AS (SELECT quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM m), s AS (SELECT count(*) AS n, avg(v) AS point, avg((v > 0)::INT) AS up FROM cv)
SELECT n, round(point, 6) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi, lo > 0 OR hi < 0 AS excludes_zero, round(up, 6) AS positive_share,
  CASE WHEN n < 20 THEN 'indicative' WHEN NOT (lo > 0 OR hi < 0) THEN 'contains_zero' WHEN point < 0 THEN 'negative' ELSE 'positive' END AS reading FROM s, q
"""


@query("clv_summary", _clv_sql("clv_pct"))
def clv_summary(t: Tables) -> DataFrame:
    return rounded(S.clv_summary(settled_bets(t), "clv_pct", "match_id", resamples=B), "point", "lo", "hi", "positive_share")


@query("clv_provisional_summary", _clv_sql("clv_pct_provisional"))
def clv_provisional_summary(t: Tables) -> DataFrame:
    return rounded(S.clv_summary(settled_bets(t), "clv_pct_provisional", "match_id", resamples=B), "point", "lo", "hi", "positive_share")


@query("clv_skip_reasons", f"WITH {BETS_SQL} SELECT clv_skipped AS reason, count(*) AS n FROM st WHERE clv_pct IS NULL AND realized_pct IS NOT NULL GROUP BY 1")
def clv_skip_reasons(t: Tables) -> DataFrame:
    return S.clv_skipped(settled_bets(t))


@query("sync_results", f"""
WITH {SNAP_SQL},
j AS (SELECT match_id AS entry_id, league, home, away, CAST(date + INTERVAL '1' DAY * (match_id % 6 - 2) AS DATE) AS date FROM matches_v),{near_snap_sql('near', 'j', 'entry_id')},
due AS (SELECT * FROM j WHERE date < DATE '2001-01-01'),
c AS (SELECT d.entry_id, m.fthg || '-' || m.ftag AS score, m.odds_source, m.odds_h, date_diff('day', d.date, m.date) AS shift, row_number() OVER (PARTITION BY d.entry_id ORDER BY abs(date_diff('day', d.date, m.date)), m.date, m.match_id) AS rn
  FROM due d JOIN matches_v m ON m.league = d.league AND m.home = d.home AND m.away = d.away AND m.fthg IS NOT NULL AND abs(date_diff('day', d.date, m.date)) <= 2)
SELECT j.entry_id, c.score AS actual_score, c.shift, CASE WHEN c.odds_h IS NOT NULL THEN c.odds_source END AS closing_source, s.h AS provisional_home, CASE WHEN j.date < DATE '2001-01-01' AND c.score IS NULL THEN 'not_in_results' END AS pending_reason
FROM j LEFT JOIN c ON c.entry_id = j.entry_id AND c.rn = 1 LEFT JOIN near s ON s.entry_id = j.entry_id
""")
def sync_results(t: Tables) -> DataFrame:
    """Past entries meet their results within two days; the rest say why they wait.

    Half of the entries store their teams, the others only the joined key, looked up among known keys.
    """
    stored = F.col("match_id") % 2 == 0
    entries = t.matches.select(
        F.col("match_id").alias("entry_id"), F.concat_ws("-", "home", "away").alias("match"), F.col("league").alias("competition"),
        F.expr("date_add(date, CAST(match_id % 6 - 2 AS INT))").alias("date"), F.when(stored, F.col("home")).alias("home"),
        F.when(stored, F.col("away")).alias("away"), F.lit(None).cast("string").alias("actual_score"),
    )
    keys = t.matches.select("league", F.concat_ws("-", "home", "away").alias("match"), "home", "away").distinct()
    out = S.sync_results(entries, keys, t.matches, J.latest_snapshot(t.book_odds), F.lit("2001-01-01").cast("date"))
    return out.select(
        "entry_id", "actual_score", "shift", F.col("closing.source").alias("closing_source"), F.col("provisional.home").alias("provisional_home"), "pending_reason"
    )


@query("manual_results", """
SELECT upper(home || '-' || away) AS match, max(match_id) AS position FROM matches_v WHERE fthg IS NULL GROUP BY 1
""")
def manual_results(t: Tables) -> DataFrame:
    """A result typed in capitals goes to the last open entry of that match."""
    entries = t.matches.select(
        F.concat_ws("-", "home", "away").alias("match"), F.col("match_id").alias("position"), F.when(F.col("fthg").isNotNull(), F.concat_ws("-", "fthg", "ftag")).alias("actual_score")
    )
    typed = t.matches.select(F.upper(F.concat_ws("-", "home", "away")).alias("match")).distinct()
    return S.last_open_entry(entries, typed).select("match", "position")


TYPED_SQL = "typed AS (SELECT home || '-' || away AS match, max(match_id) FILTER (fthg IS NULL) AS position, count(*) AS c FROM matches_v GROUP BY 1)"


def typed_results(t: Tables) -> DataFrame:
    """A result for every pair of teams, typed in capitals: goals by the number of their matches."""
    name = F.upper(F.concat_ws("-", "home", "away")).alias("match")
    counted = t.matches.groupBy(name).agg(F.count("*").alias("c"))
    return counted.select("match", F.concat_ws("-", F.col("c") % 4, F.col("c") % 3).alias("score"))


def open_journal(t: Tables) -> DataFrame:
    return journal(t).withColumns({"match": F.concat_ws("-", "home", "away"), "position": F.col("match_id")})


@query("recorded_results", f"""
WITH {BETS_SQL}, {TYPED_SQL}
SELECT b.match_id, (c % 4) || '-' || (c % 3) AS actual_score, round(CASE WHEN b.issue = CASE WHEN c % 4 > c % 3 THEN 'home' WHEN c % 4 = c % 3 THEN 'draw' ELSE 'away' END THEN stake_pct * (odds - 1) ELSE -stake_pct END, 6) AS realized_pct,
  CASE WHEN odds_source = 'pinnacle_close' THEN round(odds / close - 1, 6) END AS clv_pct,
  CASE WHEN odds_source = 'pinnacle_close' AND close IS NOT NULL THEN NULL WHEN close IS NULL THEN 'no_closing_odds' ELSE 'source_not_sharp' END AS clv_skipped, round(odds / snap - 1, 6) AS clv_pct_provisional
FROM bt b JOIN typed t ON t.position = b.match_id
""")
def recorded_results(t: Tables) -> DataFrame:
    """Entries that results typed by hand settled: score, P&L and closing-line values."""
    before = open_journal(t)
    after = S.record_results(before, typed_results(t))
    new = after.join(before.filter("actual_score IS NULL").select("position"), "position", "left_semi").filter("actual_score IS NOT NULL")
    return S.flat_bets(new, ["match_id", "actual_score"]).select("match_id", "actual_score", "realized_pct", "clv_pct", "clv_skipped", "clv_pct_provisional")


@query("unmatched_results", f"WITH {TYPED_SQL} SELECT upper(match) AS match, (c % 4) || '-' || (c % 3) AS score FROM typed WHERE position IS NULL")
def unmatched_results(t: Tables) -> DataFrame:
    """Typed results of pairs that have no unsettled entry."""
    return S.unmatched_results(open_journal(t), typed_results(t))


def entries(t: Tables) -> DataFrame:
    age = F.when(F.col("match_id") % 11 != 0, F.col("match_id") % 9)
    return market_forecasts(t).select("match_id", "date", "outcome", F.col("freq").alias("probs"), "market", age.alias("odds_age_days"), "fthg", "ftag")


BUCKET_SQL = f"""{PAIRS},
bk AS (SELECT *, CASE WHEN match_id % 11 = 0 THEN 'unknown' WHEN match_id % 9 <= 1 THEN 'fresh' WHEN match_id % 9 >= 5 THEN 'stale' ELSE 'between' END AS bucket FROM pairs),
bkm AS (SELECT * FROM bk WHERE b_market IS NOT NULL)
"""


@query("freshness_table", f"""
WITH {BUCKET_SQL},{ranked_sql('rb', 'bkm', 'b_freq, b_market', 'bucket')},{draws_sql('m', 'rb', ['b_freq', 'b_market'], SEED, 'bucket')},
q AS (SELECT bucket, quantile_cont((b_freq - b_market) / b_market * 100, 0.025) AS lo, quantile_cont((b_freq - b_market) / b_market * 100, 0.975) AS hi FROM m GROUP BY bucket)
SELECT bucket, count(*) AS n, round(avg(b_freq), 6) AS brier, round(avg(b_market), 6) AS brier_market, count(b_market) AS n_market, round((avg(b_freq) - avg(b_market)) * 100 / avg(b_market), 6) AS gap_pct, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi
FROM bk JOIN q USING (bucket) GROUP BY bucket
""")
def freshness_table(t: Tables) -> DataFrame:
    return rounded(S.freshness_table(entries(t), "match_id", resamples=B), "brier", "brier_market", "gap_pct", "lo", "hi")


@query("stale_alert", f"""
WITH {BUCKET_SQL}, ga AS (SELECT * FROM bkm WHERE bucket = 'stale'), gb AS (SELECT * FROM bkm WHERE bucket = 'fresh'),
{ranked_sql('ba', 'ga', 'b_freq, b_market')},{ranked_sql('bb', 'gb', 'b_freq, b_market')},{draws_sql('ma', 'ba', ['b_freq', 'b_market'], SEED)},{draws_sql('mb', 'bb', ['b_freq', 'b_market'], SEED + 1)},
d AS (SELECT (ma.b_freq - ma.b_market) / ma.b_market * 100 - (mb.b_freq - mb.b_market) / mb.b_market * 100 AS v FROM ma JOIN mb USING (b)), q AS (SELECT quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM d),
g AS (SELECT bucket, CASE WHEN count(*) >= 15 AND count(b_market) >= 15 THEN (avg(b_freq) - avg(b_market)) * 100 / avg(b_market) END AS gap FROM bk GROUP BY bucket),
p AS (SELECT least((SELECT count(*) FROM ga), (SELECT count(*) FROM gb)) AS n, (SELECT gap FROM g WHERE bucket = 'stale') - (SELECT gap FROM g WHERE bucket = 'fresh') AS point)
SELECT n, round(point, 6) AS point, CASE WHEN point IS NOT NULL THEN round(lo, 6) END AS lo, CASE WHEN point IS NOT NULL THEN round(hi, 6) END AS hi, CASE WHEN point IS NOT NULL THEN lo > 0 OR hi < 0 END AS excludes_zero, CASE WHEN point IS NOT NULL THEN point > 3 AND (lo > 0 OR hi < 0) END AS alert FROM p, q
""")
def stale_alert(t: Tables) -> DataFrame:
    return rounded(S.stale_alert(entries(t), "match_id", resamples=B), "point", "lo", "hi")


@query("focus_month", f"""
WITH {FORECAST_SQL},
s AS (SELECT strftime(date, '%Y-%m') AS month, match_id, any_value(outcome) AS outcome, max(brier) FILTER (method = 'freq') AS bf, max(brier) FILTER (method = 'market') AS bm, max(p[2]) FILTER (method = 'freq') AS d FROM scored GROUP BY 1, 2),
m AS (SELECT month, count(*) AS n, avg(bf) AS bf, avg(bm) AS bm, count(bm) AS nm, avg((outcome = 1)::INT) - avg(d) AS gap FROM s GROUP BY month ORDER BY month DESC LIMIT 1)
SELECT month, n, round(gap, 6) AS draw_gap, CASE WHEN abs(gap) > 0.07 THEN CASE WHEN gap > 0 THEN 'underestimated' ELSE 'overestimated' END ELSE 'ok' END AS draws,
  CASE WHEN bm IS NULL THEN 'no_market' WHEN nm < 15 THEN 'too_small' WHEN bf - bm < -0.01 THEN 'beats_market' WHEN bf - bm > 0.01 THEN 'market_better' ELSE 'equal' END AS verdict, n < 15 AS small_sample FROM m
""")
def focus_month(t: Tables) -> DataFrame:
    pick = argmax(F.col("probs"))
    rows = entries(t).withColumns({"predicted_outcome": pick, "predicted_score": F.lit("1-1"), "actual_score": F.concat_ws("-", "fthg", "ftag")})
    out = S.focus_month(M.monthly_metrics(rows))
    return rounded(out.select("month", "n", "draw_gap", "draws", "verdict", "small_sample"), "draw_gap")


@query("real_bets_pnl", """
WITH b AS (SELECT event_id, ['win', 'loss', 'void', 'pending', NULL][event_id % 5 + 1] AS result, 1.2 + (event_id % 37) / 10.0 AS taken, CASE WHEN event_id % 7 <> 0 THEN 1.3 + (event_id % 31) / 10.0 END AS journal, value AS stake FROM events)
SELECT count(*) AS n_total, count(*) FILTER (result = 'win') AS n_win, count(*) FILTER (result = 'loss') AS n_loss, count(*) FILTER (result = 'void') AS n_void, count(*) FILTER (coalesce(result, 'pending') = 'pending') AS n_pending,
  round(sum(CASE result WHEN 'win' THEN stake * (taken - 1) WHEN 'loss' THEN -stake END), 4) AS pnl, round(avg(journal / taken - 1), 6) AS mean_slippage, count(journal) AS n_slippage,
  round(sum(CASE result WHEN 'win' THEN stake * (taken - 1) WHEN 'loss' THEN -stake END) * 100 / sum(stake) FILTER (result IN ('win', 'loss')), 6) AS roi_pct, count(*) FILTER (result IN ('win', 'loss')) < 20 AS small_sample FROM b
""")
def real_bets_pnl(t: Tables) -> DataFrame:
    """Real-bet accounting over the event stream as the bet log."""
    i = F.col("event_id")
    status = F.get(F.array(F.lit("win"), F.lit("loss"), F.lit("void"), F.lit("pending"), F.lit(None)), (i % 5).cast("int"))
    rows = t.raw("events").select(
        status.alias("result"), (1.2 + (i % 37) / 10.0).alias("taken_odds"), F.when(i % 7 != 0, 1.3 + (i % 31) / 10.0).alias("journal_odds"), F.col("value").alias("stake")
    )
    return rounded(S.real_pnl(rows), "mean_slippage", "roi_pct").withColumn("pnl", F.round("pnl", 4))
