"""Grid selection, bounded minimum and freezing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DERIVED_MARKETS, KAPPA_GRID, XI_GRID, W_GRID
from ..functions import odds as O
from ..functions.outcomes import outcome_index
from ..operators import strengths as S
from ..operators import tuning as U
from ..session import keep
from ..views import Tables
from .refit import brier_sql, fit_sql, forecast_sql
from .registry import query
from .resampling import BETS, movement_bets
from .scoring import VALIDATION, rounded


def grid_sql(settings) -> str:
    """CTEs ending in ``grid``: the validation Brier of each setting by a refit in SQL."""
    return f"""{fit_sql(f'm.season IN {VALIDATION}', settings)},
{forecast_sql(f'm.season IN {VALIDATION}')},
grid AS (SELECT cell, xi, w, kappa, count(*) AS n, avg({brier_sql('p')}) AS brier FROM forecast GROUP BY ALL)"""


@query("xi_grid", f"WITH RECURSIVE {grid_sql([(x, 0.0, 2.0) for x in XI_GRID])} SELECT cell, xi, w, kappa, n, round(brier, 6) AS brier FROM grid")
def xi_grid(t: Tables) -> DataFrame:
    """Validation Brier of every decay rate (goals only)."""
    return rounded(U.validation_grid(t.played, VALIDATION, S.grid_settings(XI_GRID)), "brier")


@query("w_xi_grid")
def w_xi_grid(t: Tables) -> DataFrame:
    """Validation Brier over the whole (w, xi) grid: 48 settings in one job."""
    return rounded(U.validation_grid(t.played, VALIDATION, S.grid_settings(XI_GRID, W_GRID)), "brier")


@query("kappa_choice", f"""
WITH RECURSIVE {grid_sql([(0.003, 0.6, k) for k in KAPPA_GRID])},
a AS (SELECT arg_min(kappa, brier) AS best, min(brier) AS least, max(brier) FILTER (kappa = 2.0) AS standard FROM grid)
SELECT CASE WHEN standard - least < 1e-4 THEN 2.0 ELSE best END AS kappa, round(least, 6) AS brier, round(standard, 6) AS brier_default FROM a
""")
def kappa_choice(t: Tables) -> DataFrame:
    """Ridge weight, kept at its default unless the gain is worth it."""
    grid = U.validation_grid(t.played, VALIDATION, S.grid_settings([0.003], [0.6], KAPPA_GRID))
    return rounded(U.keep_default_unless(grid), "brier", "brier_default")


MODEL_SQL = """
v AS (SELECT CASE WHEN fthg > ftag THEN 0 WHEN fthg = ftag THEN 1 ELSE 2 END AS o, 1/open_h/(1/open_h + 1/open_d + 1/open_a) AS p0, 1/open_d/(1/open_h + 1/open_d + 1/open_a) AS p1, 1/open_a/(1/open_h + 1/open_d + 1/open_a) AS p2
  FROM matches_v WHERE fthg IS NOT NULL AND season IN (1996, 1997))
"""


def _zoom_sql(i: int) -> str:
    """One zoom pass: candidates around the previous best, mean loss per candidate, the best one."""
    prev = "SELECT 0.5::DOUBLE AS lo, 2.5::DOUBLE AS hi" if i == 0 else f"SELECT greatest(0.5, t - w) AS lo, least(2.5, t + w) AS hi FROM z{i - 1}"
    return f"""
c{i} AS (SELECT i, lo + i * ((hi - lo) / 40.0) AS t, (hi - lo) / 40.0 AS w FROM ({prev}), (SELECT unnest(range(41)) AS i)),
s{i} AS (SELECT i, t, w, avg(pow(pow(p0, t) / (pow(p0, t) + pow(p1, t) + pow(p2, t)) - (o = 0)::INT, 2) + pow(pow(p1, t) / (pow(p0, t) + pow(p1, t) + pow(p2, t)) - (o = 1)::INT, 2)
   + pow(pow(p2, t) / (pow(p0, t) + pow(p1, t) + pow(p2, t)) - (o = 2)::INT, 2)) AS loss, count(*) AS n FROM v, c{i} GROUP BY ALL),
z{i} AS (SELECT t, w, loss, n FROM s{i} ORDER BY loss, i LIMIT 1)"""


def opening_model(t: Tables, seasons) -> DataFrame:
    return t.played.filter(F.col("season").isin(*seasons)).select(
        O.fair(F.array("open_h", "open_d", "open_a"), "proportional").alias("model"), outcome_index(F.col("fthg"), F.col("ftag")).alias("outcome")
    )


@query("temperature_choice", f"WITH {MODEL_SQL},{','.join(_zoom_sql(i) for i in range(3))} SELECT round(t, 4) AS t, round(loss, 6) AS loss, n FROM z2")
def temperature_choice(t: Tables) -> DataFrame:
    """Temperature with the least validation Brier, to 1e-3."""
    out = U.tune_temperature(opening_model(t, VALIDATION), passes=3)
    return out.select(F.round("t", 4).alias("t"), F.round("loss", 6).alias("loss"), "n")


@query("market_temperatures")
def market_temperatures(t: Tables) -> DataFrame:
    """Binary temperature of each derived market, all markets in the same passes."""
    from ..functions import grid as G
    from ..functions import markets as MK

    lam = [F.col(c) for c in ("lam_h", "lam_a", "rho")]
    rows = t.rates.filter("fthg IS NOT NULL").filter(F.col("season").isin(*VALIDATION)).withColumns({"g6": G.score_grid(*lam), "g11": G.score_grid(*lam, 11)})
    have = {6: F.col("g6"), 11: F.col("g11")}
    packed = F.array(*[
        F.struct(F.lit(m).alias("market"), MK.market_prob(m, have).alias("raw_p"), MK.market_hit(m, F.col("fthg"), F.col("ftag")).alias("y")) for m in DERIVED_MARKETS
    ])
    out = U.tune_binary_temperature(keep(rows.select(F.inline(packed))))
    return out.select("market", F.round("t", 3).alias("t"), F.round("loss", 6).alias("loss"), "n")


@query("frozen_settings", """
SELECT n_name AS market, CASE WHEN n_regionkey < 3 THEN 1.0 ELSE 2.0 END AS t FROM nation
""")
def frozen_settings(t: Tables) -> DataFrame:
    """Freezing never re-tunes: keys of the first three regions stay, the others are added."""
    n = t.raw("nation").select(F.col("n_name").alias("market"), "n_regionkey")
    frozen = n.filter("n_regionkey < 3").select("market", F.lit(1.0).alias("t"))
    tuned = n.select("market", F.lit(2.0).alias("t"))
    return U.require_frozen(U.merge_frozen(frozen, tuned), n.select("market"))


@query("composite_grid", f"""
WITH {BETS}, g AS (SELECT w / 4.0 AS w, x / 100.0 AS x FROM (SELECT unnest(range(-8, 9)) AS w), (SELECT unnest(range(21)) AS x))
SELECT w, x AS threshold, count(*) AS n, round(avg(roi), 6) AS roi FROM bets, g WHERE edge + w * movement > x GROUP BY ALL
""")
def composite_grid(t: Tables) -> DataFrame:
    """Selection size and ROI over the 17 x 21 grid of weight and threshold."""
    grid = U.composite_grid(movement_bets(t), [w / 4.0 for w in range(-8, 9)], [x / 100.0 for x in range(21)])
    return rounded(grid, "roi")


@query("composite_choice", f"""
WITH {BETS}, g AS (SELECT w / 4.0 AS w, x / 100.0 AS x FROM (SELECT unnest(range(-8, 9)) AS w), (SELECT unnest(range(21)) AS x)),
s AS (SELECT w, x AS threshold, count(*) AS n, avg(roi) AS roi FROM bets, g WHERE edge + w * movement > x GROUP BY ALL HAVING count(*) >= 100)
SELECT w, threshold, n, round(roi, 6) AS roi FROM s ORDER BY round(roi, 12) DESC, w, threshold LIMIT 1
""")
def composite_choice(t: Tables) -> DataFrame:
    grid = U.composite_grid(movement_bets(t), [w / 4.0 for w in range(-8, 9)], [x / 100.0 for x in range(21)])
    return rounded(U.best_composite(grid.withColumn("roi", F.round("roi", 12))), "roi")


BLEND_ROWS = """
r AS (SELECT season, CASE WHEN fthg > ftag THEN 0 WHEN fthg = ftag THEN 1 ELSE 2 END AS o, 1/odds_h + 1/odds_d + 1/odds_a AS cb, 1/open_h + 1/open_d + 1/open_a AS ob,
   odds_h, odds_d, odds_a, open_h, open_d, open_a FROM matches_v WHERE fthg IS NOT NULL AND odds_h IS NOT NULL),
br AS (SELECT season, o, [1/odds_h/cb, 1/odds_d/cb, 1/odds_a/cb] AS cl, [1/open_h/ob, 1/open_d/ob, 1/open_a/ob] AS op, [0.45, 0.27, 0.28] AS md FROM r)
"""


def blend_rows(t: Tables) -> DataFrame:
    """Closing and opening fair triples with a constant forecast as the model."""
    return t.played.filter("odds_h IS NOT NULL").select(
        "season", outcome_index(F.col("fthg"), F.col("ftag")).alias("outcome"),
        O.fair(F.array("odds_h", "odds_d", "odds_a"), "proportional").alias("close"),
        O.fair(F.array("open_h", "open_d", "open_a"), "proportional").alias("open"),
        F.array(F.lit(0.45), F.lit(0.27), F.lit(0.28)).alias("model"),
    )


@query("blend_weight_grid", f"""
WITH {BLEND_ROWS}, g AS (SELECT o, md, age, [(1 - least(age / 7.0, 1)) * cl[1] + least(age / 7.0, 1) * op[1], (1 - least(age / 7.0, 1)) * cl[2] + least(age / 7.0, 1) * op[2], (1 - least(age / 7.0, 1)) * cl[3] + least(age / 7.0, 1) * op[3]] AS mk
   FROM br, (SELECT unnest([0, 1, 3, 5, 7]) AS age)),
w AS (SELECT unnest(range(21)) / 20.0 AS w)
SELECT age, w, round(avg((w*mk[1] + (1-w)*md[1] - (o = 0)::INT)**2 + (w*mk[2] + (1-w)*md[2] - (o = 1)::INT)**2 + (w*mk[3] + (1-w)*md[3] - (o = 2)::INT)**2), 6) AS brier FROM g, w GROUP BY ALL
""")
def blend_weight_grid(t: Tables) -> DataFrame:
    """Blend Brier over 21 weights and five ages, from three means per age."""
    return rounded(U.weight_grid(U.blend_coefficients(blend_rows(t))).select("age", "w", "brier"), "brier")
