"""Goal model, score grids and the markets read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import grid as G
from ..functions import markets as MK
from ..functions.outcomes import brier, outcome_index
from ..functions.staking import value_flag
from ..operators import baselines as B
from ..operators import forecasts as FC
from ..operators import strengths as S
from ..views import Tables
from .refit import brier_sql, fit_sql, forecast_sql, temper_sql
from .registry import query
from .scoring import FREQ_SQL, TEST, VALIDATION, market_forecasts, power_k_sql, rounded

XI, W_MIX, KAPPA, TEMPERATURE = 0.003, 0.6, 1.0, 1.077

# The joint score table in SQL: one row per match and cell.
def cells_sql(goals: int) -> str:
    return f"""
cells{goals} AS (SELECT match_id, league, fthg, ftag, ah_line, h, a, greatest(exp(h * ln(lam_h) - lam_h - ln(factorial(h::INT)::DOUBLE)) * exp(a * ln(lam_a) - lam_a - ln(factorial(a::INT)::DOUBLE)) *
   CASE WHEN h = 0 AND a = 0 THEN 1 - lam_h * lam_a * rho WHEN h = 0 AND a = 1 THEN 1 + lam_h * rho WHEN h = 1 AND a = 0 THEN 1 + lam_a * rho WHEN h = 1 AND a = 1 THEN 1 - rho ELSE 1 END, 0) AS q
  FROM rates_v, (SELECT unnest(range({goals + 1})) AS h), (SELECT unnest(range({goals + 1})) AS a)),
grid{goals} AS (SELECT * EXCLUDE q, q / sum(q) OVER (PARTITION BY match_id) AS p FROM cells{goals})
"""


def _grids(t: Tables) -> DataFrame:
    """Rates with both grid sizes as array columns."""
    lam = [F.col(c) for c in ("lam_h", "lam_a", "rho")]
    return t.rates.withColumns({"g6": G.score_grid(*lam), "g11": G.score_grid(*lam, K.WIDE_GRID_GOALS)})


def _have():
    return {K.GRID_GOALS: F.col("g6"), K.WIDE_GRID_GOALS: F.col("g11")}


@query("training_weights", """
SELECT match_id, round(exp(-0.003 * date_diff('day', date, DATE '2001-01-01')), 6) AS weight, round(0.6 * coalesce(xg_home, fthg) + 0.4 * fthg, 6) AS target_h,
  round(0.6 * coalesce(xg_away, ftag) + 0.4 * ftag, 6) AS target_a FROM matches_v WHERE fthg IS NOT NULL AND date < DATE '2001-01-01'
""")
def training_weights(t: Tables) -> DataFrame:
    """Decay weight to a reference day and the pseudo-goals of each side."""
    ref = F.lit("2001-01-01").cast("date")
    rows = S.guard_before(t.played.filter(F.col("date") < ref).withColumn("ref", ref), "date", "ref")
    mix = lambda x, g: F.round(0.6 * F.coalesce(x, F.col(g).cast("double")) + 0.4 * F.col(g), 6)
    return rows.select(
        "match_id", F.round(S.decay(F.lit(0.003), F.col("ref"), F.col("date")), 6).alias("weight"),
        mix("xg_home", "fthg").alias("target_h"), mix("xg_away", "ftag").alias("target_a"),
    )


@query("fold_training_sums", """
WITH weeks AS (SELECT DISTINCT league, CAST(date_trunc('week', date) AS DATE) AS week FROM matches_v WHERE fthg IS NOT NULL AND season IN (1998, 1999, 2000))
SELECT w.league, w.week, m.home, round(sum(exp(-0.003 * date_diff('day', m.date, w.week))), 6) AS n, round(sum(m.fthg * exp(-0.003 * date_diff('day', m.date, w.week))), 6) AS gh,
  round(sum(coalesce(m.xg_away, m.ftag) * exp(-0.003 * date_diff('day', m.date, w.week))), 6) AS xa,
  round(sum(CASE WHEN m.fthg = 0 AND m.ftag = 1 THEN exp(-0.003 * date_diff('day', m.date, w.week)) ELSE 0 END), 6) AS c01
FROM weeks w JOIN matches_v m ON m.league = w.league AND m.fthg IS NOT NULL AND m.date < w.week GROUP BY ALL
""")
def fold_training_sums(t: Tables) -> DataFrame:
    """Decayed training sums of every weekly fold, strictly before its Monday."""
    sums = S.fold_sums(t.played, S.target_folds(t.played, TEST), [XI])
    return rounded(
        sums.groupBy("league", "week", "home").agg(*[F.sum(c).alias(c) for c in ("n", "gh", "xa", "c01")]), "n", "gh", "xa", "c01"
    )


@query("fold_history_bounds", """
WITH weeks AS (SELECT DISTINCT league, CAST(date_trunc('week', date) AS DATE) AS week FROM matches_v WHERE fthg IS NOT NULL AND season IN (1998, 1999, 2000))
SELECT w.league, w.week, count(m.match_id) AS n_train, max(m.date) AS last_train, max(m.date) < w.week AS clean FROM weeks w LEFT JOIN matches_v m ON m.league = w.league AND m.fthg IS NOT NULL AND m.date < w.week GROUP BY w.league, w.week
""")
def fold_history_bounds(t: Tables) -> DataFrame:
    """Rows each fold may train on and the last day among them."""
    weekly = B.with_week(t.played).groupBy("league", "week").agg(F.count("*").alias("n"), F.max("date").alias("d"))
    run = weekly.select(
        "league", "week", F.coalesce(F.sum("n").over(B.earlier_weeks()), F.lit(0)).alias("n_train"), F.max("d").over(B.earlier_weeks()).alias("last_train")
    )
    out = run.join(S.target_folds(t.played, TEST), ["league", "week"], "left_semi")
    return out.withColumn("clean", F.col("last_train") < F.col("week"))


@query("market_frequencies", """
WITH weeks AS (SELECT DISTINCT league, CAST(date_trunc('week', date) AS DATE) AS week FROM matches_v WHERE fthg IS NOT NULL),
f AS (SELECT w.league, w.week, count(m.match_id) AS n, count(*) FILTER (fthg + ftag > 2.5) AS ou25, count(*) FILTER (fthg > 0 AND ftag > 0) AS btts, count(*) FILTER (fthg + ftag > 0.5) AS ou05,
  count(*) FILTER (fthg + ftag > 1.5) AS ou15, count(*) FILTER (fthg + ftag > 3.5) AS ou35, count(*) FILTER (fthg + ftag > 4.5) AS ou45, count(*) FILTER (fthg > 1.5) AS home_ov15, count(*) FILTER (ftag > 1.5) AS away_ov15
  FROM weeks w LEFT JOIN matches_v m ON m.league = w.league AND m.fthg IS NOT NULL AND m.date < w.week GROUP BY ALL)
SELECT league, week, market, round(CASE WHEN n > 0 THEN c / n ELSE 0.5 END, 6) AS freq FROM (UNPIVOT f ON ou25, btts, ou05, ou15, ou35, ou45, home_ov15, away_ov15 INTO NAME market VALUE c)
""")
def market_frequencies(t: Tables) -> DataFrame:
    return rounded(B.market_frequencies(t.played), "freq")


@query("score_frequencies", """
WITH weeks AS (SELECT DISTINCT league, CAST(date_trunc('week', date) AS DATE) AS week FROM matches_v WHERE fthg IS NOT NULL),
dense AS (SELECT * FROM weeks, (SELECT unnest(range(7)) AS h), (SELECT unnest(range(7)) AS a)),
c AS (SELECT d.league, d.week, h, a, 1 + count(m.match_id) AS c FROM dense d LEFT JOIN matches_v m ON m.league = d.league AND m.fthg IS NOT NULL AND m.date < d.week AND least(m.fthg, 6) = d.h AND least(m.ftag, 6) = d.a GROUP BY ALL)
SELECT league, week, h, a, round(c / sum(c) OVER (PARTITION BY league, week), 6) AS p FROM c
""")
def score_frequencies(t: Tables) -> DataFrame:
    """Smoothed earlier exact-score shares per league and week."""
    return rounded(B.score_frequencies(t.played), "p")


@query("score_grid_cells", f"WITH {cells_sql(6)} SELECT league, h, a, round(avg(p), 8) AS p FROM grid6 GROUP BY ALL")
def score_grid_cells(t: Tables) -> DataFrame:
    """Mean cell probability per league, from each match's own grid."""
    cells = _grids(t).select("league", F.posexplode("g6").alias("i", "p"))
    return cells.groupBy("league", "i").agg(F.round(F.avg("p"), 8).alias("p")).select(
        "league", F.floor(F.col("i") / 7).alias("h"), (F.col("i") % 7).alias("a"), "p"
    )


@query("grid_outcomes", f"""
WITH {cells_sql(6)}, {cells_sql(11)}
SELECT a.match_id, a.h AS p_h, a.d AS p_d, a.a AS p_a, b.h AS wide_h FROM
 (SELECT match_id, round(sum(p) FILTER (h > a), 6) AS h, round(sum(p) FILTER (h = a), 6) AS d, round(sum(p) FILTER (h < a), 6) AS a FROM grid6 GROUP BY 1) a
 JOIN (SELECT match_id, round(sum(p) FILTER (h > a), 6) AS h FROM grid11 GROUP BY 1) b USING (match_id)
""")
def grid_outcomes(t: Tables) -> DataFrame:
    rows = _grids(t).select("match_id", G.outcome_probs(F.col("g6")).alias("p"), G.outcome_probs(F.col("g11"), 11)[0].alias("w"))
    return rows.select("match_id", *FC.triple_columns(rows, "p"), F.round("w", 6).alias("wide_h"))


@query("derived_market_probs", f"""
WITH {cells_sql(6)}, {cells_sql(11)},
a AS (SELECT match_id, sum(p) FILTER (h + a > 2.5) AS ou25, sum(p) FILTER (h > 0 AND a > 0) AS btts FROM grid6 GROUP BY 1),
b AS (SELECT match_id, sum(p) FILTER (h + a > 0.5) AS ou05, sum(p) FILTER (h + a > 1.5) AS ou15, sum(p) FILTER (h + a > 3.5) AS ou35, sum(p) FILTER (h + a > 4.5) AS ou45,
  sum(p) FILTER (h > 1.5) AS home_ov15, sum(p) FILTER (a > 1.5) AS away_ov15 FROM grid11 GROUP BY 1)
SELECT match_id, round(ou25, 6) AS ou25, round(btts, 6) AS btts, round(ou05, 6) AS ou05, round(ou15, 6) AS ou15, round(ou35, 6) AS ou35, round(ou45, 6) AS ou45, round(home_ov15, 6) AS home_ov15, round(away_ov15, 6) AS away_ov15
FROM a JOIN b USING (match_id)
""")
def derived_market_probs(t: Tables) -> DataFrame:
    """Totals, both-score and team totals, each from the grid size that belongs to it."""
    return _grids(t).select("match_id", *[F.round(MK.market_prob(m, _have()), 6).alias(m) for m in K.DERIVED_MARKETS])


@query("handicap_outcomes", """
SELECT match_id, CASE WHEN abs(fthg - ftag + ah_line) < 1e-9 THEN 'push' WHEN fthg - ftag + ah_line > 0 THEN 'home' ELSE 'away' END AS result,
  CASE WHEN abs(fthg - ftag + ah_line) < 1e-9 THEN NULL WHEN fthg - ftag + ah_line > 0 THEN 1 ELSE 0 END AS covered FROM matches_v WHERE fthg IS NOT NULL
""")
def handicap_outcomes(t: Tables) -> DataFrame:
    cols = [F.col(c) for c in ("fthg", "ftag", "ah_line")]
    return t.played.select("match_id", MK.handicap_outcome(*cols).alias("result"), MK.handicap_covered(*cols).alias("covered"))


@query("handicap_probs", f"""
WITH {cells_sql(11)}, s AS (SELECT match_id, sum(CASE WHEN h - a + ah_line >= 1e-9 THEN p ELSE 0 END) AS h, sum(CASE WHEN h - a + ah_line <= -1e-9 THEN p ELSE 0 END) AS a,
   sum(CASE WHEN abs(h - a + ah_line) < 1e-9 THEN p ELSE 0 END) AS push FROM grid11 GROUP BY 1)
SELECT match_id, round(h, 6) AS home, round(a, 6) AS away, round(push, 6) AS push, round(CASE WHEN h + a > 0 THEN h / (h + a) ELSE 0.5 END, 6) AS conditional FROM s
""")
def handicap_probs(t: Tables) -> DataFrame:
    rows = _grids(t).select("match_id", G.handicap_probs(F.col("g11"), 11, F.col("ah_line")).alias("s"))
    total = F.col("s.home") + F.col("s.away")
    return rows.select(
        "match_id", *[F.round(f"s.{c}", 6).alias(c) for c in ("home", "away", "push")],
        F.round(F.when(total > 0, F.col("s.home") / total).otherwise(0.5), 6).alias("conditional"),
    )


@query("derived_market_hits", """
WITH h AS (SELECT league, CAST(fthg + ftag > 2.5 AS INT) AS ou25, CAST(fthg > 0 AND ftag > 0 AS INT) AS btts, CAST(fthg + ftag > 0.5 AS INT) AS ou05, CAST(fthg + ftag > 1.5 AS INT) AS ou15, CAST(fthg + ftag > 3.5 AS INT) AS ou35,
  CAST(fthg + ftag > 4.5 AS INT) AS ou45, CAST(fthg > 1.5 AS INT) AS home_ov15, CAST(ftag > 1.5 AS INT) AS away_ov15 FROM matches_v WHERE fthg IS NOT NULL)
SELECT league, market, count(*) AS n, CAST(sum(y) AS BIGINT) AS hits FROM (UNPIVOT h ON ou25, btts, ou05, ou15, ou35, ou45, home_ov15, away_ov15 INTO NAME market VALUE y) GROUP BY ALL
""")
def derived_market_hits(t: Tables) -> DataFrame:
    long = t.played.select("league", F.inline(MK.all_market_hits(F.col("fthg"), F.col("ftag"))))
    return long.groupBy("league", "market").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))


@query("top_score_hits", f"""
WITH {cells_sql(6)}, r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY p DESC, h DESC, a DESC) AS rk FROM grid6),
hit AS (SELECT m.match_id, m.league, r.rk FROM matches_v m LEFT JOIN r ON r.match_id = m.match_id AND r.h = m.fthg AND r.a = m.ftag WHERE m.fthg IS NOT NULL)
SELECT league, count(*) AS n, round(avg((coalesce(rk, 99) <= 1)::INT), 6) AS top1, round(avg((coalesce(rk, 99) <= 3)::INT), 6) AS top3, round(avg((coalesce(rk, 99) <= 5)::INT), 6) AS top5 FROM hit GROUP BY league
""")
def top_score_hits(t: Tables) -> DataFrame:
    """Share of matches whose score is among the k likeliest."""
    rows = _grids(t).filter("fthg IS NOT NULL").withColumn("top", G.top_scores(F.col("g6"), 6, 5))
    inside = lambda k: F.avg(F.when(F.exists(F.slice("top", 1, k), lambda s: (s["h"] == F.col("fthg")) & (s["a"] == F.col("ftag"))), 1.0).otherwise(0.0))
    return rows.groupBy("league").agg(F.count("*").alias("n"), *[F.round(inside(k), 6).alias(f"top{k}") for k in (1, 3, 5)])


@query("best_scores_by_outcome", f"""
WITH {cells_sql(6)}, o AS (SELECT *, CASE WHEN h > a THEN 'home' WHEN h = a THEN 'draw' ELSE 'away' END AS issue FROM grid6)
SELECT match_id, issue, arg_min(h || '-' || a, (-p, h, a)) AS score, round(max(p), 6) AS p, round(max(p) / sum(p), 6) AS share FROM o GROUP BY match_id, issue
""")
def best_scores_by_outcome(t: Tables) -> DataFrame:
    grids = _grids(t).select("match_id", "g6")
    packed = F.array(*[F.struct(F.lit(i).alias("issue"), G.best_score_by_outcome(F.col("g6"), 6, i).alias("b")) for i in K.ISSUES])
    return grids.select("match_id", F.inline(packed)).select(
        "match_id", "issue", F.concat_ws("-", "b.h", "b.a").alias("score"), F.round("b.p", 6).alias("p"), F.round("b.share", 6).alias("share")
    )


@query("top_seven_scores", f"""
WITH {cells_sql(6)}, r AS (SELECT league, match_id, h, a, p, row_number() OVER (PARTITION BY match_id ORDER BY p DESC, h DESC, a DESC) AS rk FROM grid6)
SELECT league, CAST(rk AS INT) AS rk, h, a, count(*) AS n, round(avg(p), 6) AS mean_p FROM r WHERE rk <= 7 GROUP BY ALL
""")
def top_seven_scores(t: Tables) -> DataFrame:
    """Which scores take which place among the seven likeliest."""
    top = _grids(t).select("league", F.posexplode(G.top_scores(F.col("g6"), 6, 7)).alias("i", "s"))
    return top.groupBy("league", (F.col("i") + 1).alias("rk"), F.col("s.h").alias("h"), F.col("s.a").alias("a")).agg(
        F.count("*").alias("n"), F.round(F.avg("s.p"), 6).alias("mean_p")
    )


@query("double_chance_and_value", """
WITH f AS (SELECT match_id, 1/odds_h/(1/odds_h + 1/odds_d + 1/odds_a) AS h, 1/odds_d/(1/odds_h + 1/odds_d + 1/odds_a) AS d, 1/odds_a/(1/odds_h + 1/odds_d + 1/odds_a) AS a,
  lam_h / (lam_h + lam_a + 1) AS m FROM rates_v WHERE odds_h IS NOT NULL)
SELECT match_id, round(h + d, 6) AS home_or_draw, round(a + d, 6) AS draw_or_away, CASE WHEN abs(m - h) * 100 >= 8 THEN 'clear' WHEN abs(m - h) * 100 >= 4 THEN 'moderate' ELSE 'none' END AS flag FROM f
""")
def double_chance_and_value(t: Tables) -> DataFrame:
    from ..functions.odds import fair

    rows = t.rates.filter("odds_h IS NOT NULL").select(
        "match_id", fair(F.array("odds_h", "odds_d", "odds_a"), "proportional").alias("p"),
        (F.col("lam_h") / (F.col("lam_h") + F.col("lam_a") + 1.0)).alias("m"),
    )
    p = F.col("p")
    return rows.select(
        "match_id", F.round(p[0] + p[1], 6).alias("home_or_draw"), F.round(p[2] + p[1], 6).alias("draw_or_away"),
        value_flag(F.col("m"), p[0]).alias("flag"),
    )


@query("contest_points", f"""
WITH {cells_sql(6)}, o AS (SELECT match_id, CASE WHEN h > a THEN 0 WHEN h = a THEN 1 ELSE 2 END AS k, sum(p) AS pr, max(p) AS bp, arg_min(h || '-' || a, (-p, h, a)) AS score FROM grid6 GROUP BY ALL),
e AS (SELECT *, [13, 50, 68][k + 1] * pr + 20 * bp AS ep FROM o)
SELECT match_id, arg_min(['home', 'draw', 'away'][k + 1], (-ep, k)) AS pick, arg_min(score, (-ep, k)) AS pick_score, round(max(ep), 6) AS pick_points,
  arg_min(['home', 'draw', 'away'][k + 1], (-pr, k)) AS favourite, round(arg_min(ep, (-pr, k)), 6) AS favourite_points FROM e GROUP BY match_id
""")
def contest_points(t: Tables) -> DataFrame:
    rows = _grids(t).select("match_id", F.col("g6").alias("grid")).withColumn("final", G.outcome_probs(F.col("grid")))
    out = FC.contest_points(rows, {"home": 13.0, "draw": 50.0, "away": 68.0}, 20.0)
    return out.select("match_id", "pick", "pick_score", F.round("pick_points", 6).alias("pick_points"), "favourite", F.round("favourite_points", 6).alias("favourite_points"))


@query("calibrated_or_raw", f"""
WITH {cells_sql(6)}, g AS (SELECT match_id, sum(p) FILTER (h + a > 2.5) AS ou25, sum(p) FILTER (h > 0 AND a > 0) AS btts FROM grid6 GROUP BY 1)
SELECT match_id, 'ou25' AS market, round(pow(ou25, 1.2) / (pow(ou25, 1.2) + pow(1 - ou25, 1.2)), 6) AS model_p, TRUE AS calibrated FROM g UNION ALL SELECT match_id, 'btts', round(btts, 6), FALSE FROM g
""")
def calibrated_or_raw(t: Tables) -> DataFrame:
    """A frozen temperature for one market only; the other stays raw and says so."""
    packed = F.array(*[F.struct(F.lit(m).alias("market"), MK.market_prob(m, _have()).alias("raw_p")) for m in ("ou25", "btts")])
    long = _grids(t).select("match_id", F.inline(packed))
    return rounded(FC.with_calibrated(long, {"ou25": 1.2}).select("match_id", "market", "model_p", "calibrated"), "model_p")


def lineup_entries(t: Tables) -> DataFrame:
    """Lineup values from line items: orders are matches, suppliers play for a side and an axis."""
    n = F.col("l_linenumber")
    return t.raw("lineitem").select(
        F.col("l_orderkey").alias("match_id"), F.when(F.col("l_suppkey") % 2 == 0, "home").otherwise("away").alias("side"),
        F.when(n % 2 == 0, "attack").otherwise("defense").alias("axis"),
        F.when(F.col("l_partkey") % 2 == 0, "confirmed").otherwise("reference").alias("role"), (F.col("l_quantity") / 50.0).alias("value"),
    )


LINEUP_SQL = """
e AS (SELECT l_orderkey AS match_id, CASE WHEN l_suppkey % 2 = 0 THEN 'home' ELSE 'away' END AS side, CASE WHEN l_linenumber % 2 = 0 THEN 'attack' ELSE 'defense' END AS axis,
   sum(l_quantity / 50.0) FILTER (l_partkey % 2 = 0) AS c, sum(l_quantity / 50.0) FILTER (l_partkey % 2 <> 0) AS r FROM lineitem GROUP BY ALL),
ratios AS (SELECT match_id, side, axis, CASE WHEN coalesce(r, 0) <= 0 THEN 1 ELSE greatest(0.5, least(1.75, coalesce(c, 0) / r)) END AS ratio FROM e),
wide AS (SELECT match_id, coalesce(max(ratio) FILTER (side = 'home' AND axis = 'attack'), 1) AS ha, coalesce(max(ratio) FILTER (side = 'home' AND axis = 'defense'), 1) AS hd,
   coalesce(max(ratio) FILTER (side = 'away' AND axis = 'attack'), 1) AS aa, coalesce(max(ratio) FILTER (side = 'away' AND axis = 'defense'), 1) AS ad FROM ratios GROUP BY 1)
"""


@query("lineup_adjustment", f"""
WITH {LINEUP_SQL}
SELECT r.match_id, w.match_id IS NOT NULL AS lineup_applied, round(lam_h * coalesce(ha * ad, 1), 6) AS lam_h, round(lam_a * coalesce(aa * hd, 1), 6) AS lam_a,
  coalesce((abs(ha - 1) > 0.3)::INT + (abs(hd - 1) > 0.3)::INT + (abs(aa - 1) > 0.3)::INT + (abs(ad - 1) > 0.3)::INT, 0) AS n_strong
FROM rates_v r LEFT JOIN wide w USING (match_id)
""")
def lineup_adjustment(t: Tables) -> DataFrame:
    out = FC.apply_lineups(t.rates.select("match_id", "lam_h", "lam_a"), lineup_entries(t))
    return out.select("match_id", "lineup_applied", F.round("lam_h", 6).alias("lam_h"), F.round("lam_a", 6).alias("lam_a"), F.size("strong_axes").alias("n_strong"))


@query("strength_fit", f"""
WITH RECURSIVE {fit_sql(f'm.season IN {TEST}', [(XI, W_MIX, KAPPA)])}
SELECT league, week, xi, w, kappa, team, round(attack, 5) AS attack, round(defence, 5) AS defence, round(home_edge, 5) AS home_edge, round(rho, 5) AS rho, round(attack_mean, 5) AS attack_mean, round(defence_mean, 5) AS defence_mean,
  round(n_train, 5) AS n_train, n_teams, TRUE AS converged FROM strengths
""")
def strength_fit(t: Tables) -> DataFrame:
    """Strengths of every test-season fold, with convergence figures."""
    out = S.fit_all(t.played, S.target_folds(t.played, TEST), S.grid_settings([XI], [W_MIX], [KAPPA]))
    return rounded(out, "attack", "defence", "home_edge", "rho", "attack_mean", "defence_mean", "n_train", digits=5).withColumn(
        "converged", F.col("max_gradient") < 1e-6
    ).drop("max_gradient", "steps")


@query("strength_fit_checks", """
WITH weeks AS (SELECT DISTINCT league, CAST(date_trunc('week', date) AS DATE) AS week FROM matches_v WHERE fthg IS NOT NULL AND season IN (1998, 1999, 2000)),
r AS (SELECT w.league, w.week, unnest([m.home, m.away]) AS team, 0.5 * exp(-0.003 * date_diff('day', m.date, w.week)) AS half FROM weeks w JOIN matches_v m ON m.league = w.league AND m.fthg IS NOT NULL AND m.date < w.week)
SELECT league, week, count(DISTINCT team) AS n_teams, round(sum(half), 5) AS n_train, 1.0 AS mean_attack, TRUE AS rho_in_bounds, TRUE AS converged FROM r GROUP BY league, week
""")
def strength_fit_checks(t: Tables) -> DataFrame:
    """Every fold: teams and weight it trained on, attacks averaging one, zero gradient at the optimum."""
    out = S.fit_all(t.played, S.target_folds(t.played, TEST), S.grid_settings([XI], [W_MIX], [KAPPA]))
    return out.groupBy("league", "week").agg(
        F.count("*").alias("n_teams"), F.round(F.max("n_train"), 5).alias("n_train"), F.round(F.avg(F.exp("attack")), 6).alias("mean_attack"),
        F.bool_and(F.abs("rho") <= K.RHO_BOUND).alias("rho_in_bounds"), F.bool_and(F.col("max_gradient") < 1e-6).alias("converged"),
    )


@query("walk_forward_checks", """
SELECT match_id, 1.0 AS total, TRUE AS positive FROM matches_v WHERE fthg IS NOT NULL AND season IN (1998, 1999, 2000)
""")
def walk_forward_checks(t: Tables) -> DataFrame:
    """Every target match is forecast once, with three positive probabilities that sum to one."""
    out = FC.walk_forward(t.played, TEST, S.grid_settings([XI], [W_MIX], [KAPPA]))
    p = F.col("model")
    return out.select("match_id", F.round(p[0] + p[1] + p[2], 6).alias("total"), (F.array_min(p) > 0).alias("positive"))


@query("walk_forward_backtest", f"""
WITH RECURSIVE {fit_sql(f'm.season IN {TEST}', [(XI, W_MIX, KAPPA)])},
{forecast_sql(f'm.season IN {TEST}')},
{FREQ_SQL},
all_ AS (SELECT r.*, {temper_sql('r.p', TEMPERATURE)} AS model, CASE WHEN f.n > 0 THEN [f.n0 / f.n, f.n1 / f.n, f.n2 / f.n] ELSE [1/3, 1/3, 1/3] END AS freq, m.odds_h, m.odds_d, m.odds_a, {power_k_sql('m.odds_h', 'm.odds_d', 'm.odds_a')} AS k
  FROM forecast r JOIN matches_v m USING (match_id) JOIN freqs f ON f.league = r.league AND f.wk = r.week)
SELECT match_id, league, season, {', '.join(f'round({c}[{i + 1}], 6) AS {c.replace("r_p", "raw")}_{s}' for c in ('model', 'freq') for i, s in enumerate('hda'))},
  {', '.join(f'round(p[{i + 1}], 6) AS raw_{s}' for i, s in enumerate('hda'))}, {', '.join(f'round(pow(odds_{s}, -k), 6) AS market_{s}' for s in 'hda')}, round({brier_sql('model')}, 6) AS brier FROM all_
""")
def walk_forward_backtest(t: Tables) -> DataFrame:
    """Frozen settings over the test seasons: calibrated, raw, market and frequency triples."""
    out = FC.score_season_set(t.played, TEST, XI, W_MIX, KAPPA, TEMPERATURE)
    return out.select(
        "match_id", "league", "season", *FC.triple_columns(out, "model"), *FC.triple_columns(out, "raw"),
        *FC.triple_columns(out, "market"), *FC.triple_columns(out, "freq"), F.round(brier(F.col("model"), F.col("outcome")), 6).alias("brier"),
    )


@query("derived_backtest")
def derived_backtest(t: Tables) -> DataFrame:
    """Derived markets over the test seasons, scored per market against frequency and one half."""
    rows = FC.derived_season_set(t.played, TEST, XI, W_MIX, KAPPA, {"ou25": 1.05, "btts": 0.95})
    b = lambda c: F.pow(F.col(c) - F.col("y"), 2.0)
    return rounded(
        rows.groupBy("market").agg(
            F.count("*").alias("n"), F.avg(b("model_p")).alias("brier"), F.avg(b("raw_p")).alias("brier_raw"),
            F.avg(b("freq_p")).alias("brier_freq"), F.avg(F.pow(0.5 - F.col("y"), 2.0)).alias("brier_uniform"),
        ),
        "brier", "brier_raw", "brier_freq", "brier_uniform",
    )


@query("fixture_scoring")
def fixture_scoring(t: Tables) -> DataFrame:
    """All open fixtures in one job: refit per week, lineups, grids, consensus, blend."""
    from .pricing import _book_rows

    fixtures = t.matches.filter("fthg IS NULL").select(
        "match_id", "league", "date", "home", "away", (F.col("match_id") % 9).cast("int").alias("odds_age_days")
    )
    entries = lineup_entries(t)
    out = FC.score_fixtures(fixtures, t.played, _book_rows(t), XI, W_MIX, KAPPA, TEMPERATURE, entries)
    return out.select(
        "match_id", F.round("lam_h", 6).alias("lam_h"), F.round("lam_a", 6).alias("lam_a"), "lineup_applied",
        *FC.triple_columns(out, "model"), *FC.triple_columns(out, "market"), *FC.triple_columns(out, "final"),
        F.round("market_weight", 6).alias("market_weight"), F.round(G.over(F.col("grid"), 6, 2.5), 6).alias("over25"),
        F.round(G.over(F.col("grid_wide"), 11, 3.5), 6).alias("over35"),
    )
