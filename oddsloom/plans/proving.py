"""Fitted models side by side, and leak tests that fit again on shuffled labels; each held against a refit in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import odds as O
from ..functions.outcomes import brier, uniform
from ..operators import forecasts as FC
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import resample as R
from ..operators import result_sets as RS
from ..operators import strengths as S
from ..operators.baselines import with_frequency
from ..session import keep
from ..views import Tables
from .goals import KAPPA, TEMPERATURE, W_MIX, XI
from .refit import brier_sql, fit_sql, forecast_sql, temper_sql
from .registry import query
from .resampling import B, mix_sql
from .scoring import FREQ_SQL, LEAK, TEST, power_k_sql, rounded

GOALS_ONLY = (0.002, 0.0, 2.0)
WITH_XG = (XI, W_MIX, KAPPA)
SETTINGS = (GOALS_ONLY, WITH_XG)
MODELS = ("goals", "xg", "xg_calibrated", "freq", "market", "uniform")


def chosen(settings) -> list[S.Setting]:
    return [S.Setting(i, *s) for i, s in enumerate(settings)]


def is_setting(setting) -> F.Column:
    return (F.col("xi") == setting[0]) & (F.col("w") == setting[1]) & (F.col("kappa") == setting[2])


def prediction_store(t: Tables) -> DataFrame:
    """Test-season predictions of both goal models, raw and calibrated, of the market, the frequencies and the uniform triple."""
    preds = keep(FC.walk_forward(t.played, TEST, chosen(SETTINGS)))
    goals, xg = preds.filter(is_setting(GOALS_ONLY)), preds.filter(is_setting(WITH_XG))
    base = with_frequency(t.played, TEST).withColumn("outcome", FC.outcome_index(F.col("fthg"), F.col("ftag")))
    market = O.fair(F.array("odds_h", "odds_d", "odds_a"), "power")
    sets = (
        RS.result_set(goals, "goals", F.col("model")), RS.result_set(xg, "xg", F.col("model")),
        RS.result_set(xg, "xg_calibrated", O.temper(F.col("model"), F.lit(TEMPERATURE))),
        RS.result_set(base, "freq", F.col("freq")), RS.result_set(base, "market", market), RS.result_set(base, "uniform", uniform()),
    )
    store = sets[0]
    for new in sets[1:]:
        store = store.unionByName(new)
    return store


STORE_SQL = f"""
{fit_sql(f'm.season IN {TEST}', SETTINGS)},
{forecast_sql(f'm.season IN {TEST}')},
{FREQ_SQL},
base AS (SELECT m.match_id, m.league, m.season, m.home, m.away, m.odds_h, m.odds_d, m.odds_a, CASE WHEN m.fthg > m.ftag THEN 0 WHEN m.fthg = m.ftag THEN 1 ELSE 2 END AS outcome,
    CASE WHEN f.n > 0 THEN [f.n0 / f.n, f.n1 / f.n, f.n2 / f.n] ELSE [1/3, 1/3, 1/3] END AS freq, {power_k_sql('m.odds_h', 'm.odds_d', 'm.odds_a')} AS k
  FROM matches_v m JOIN freqs f ON f.league = m.league AND f.wk = CAST(date_trunc('week', m.date) AS DATE) WHERE m.fthg IS NOT NULL AND m.season IN {TEST}),
store AS MATERIALIZED (SELECT 'goals' AS model, match_id, league, season, outcome, p FROM forecast WHERE cell = 0
  UNION ALL SELECT 'xg', match_id, league, season, outcome, p FROM forecast WHERE cell = 1
  UNION ALL SELECT 'xg_calibrated', match_id, league, season, outcome, {temper_sql('p', TEMPERATURE)} FROM forecast WHERE cell = 1
  UNION ALL SELECT 'freq', match_id, league, season, outcome, freq FROM base
  UNION ALL SELECT 'market', match_id, league, season, outcome, [pow(odds_h, -k), pow(odds_d, -k), pow(odds_a, -k)] FROM base WHERE odds_h IS NOT NULL
  UNION ALL SELECT 'uniform', match_id, league, season, outcome, [1/3, 1/3, 1/3] FROM base),
common_id AS (SELECT match_id FROM store GROUP BY match_id HAVING count(DISTINCT model) = {len(MODELS)}),
scored AS MATERIALIZED (SELECT *, {brier_sql('p')} AS brier, -ln(greatest(p[outcome + 1], 1e-12)) AS ll, CASE WHEN list_position(p, list_max(p)) - 1 = outcome THEN 1.0 ELSE 0.0 END AS ok FROM store)
"""


@query("model_comparison", f"""
WITH RECURSIVE {STORE_SQL},
s AS (SELECT model, count(*) AS n, avg(brier) AS brier, avg(ll) AS log_loss, avg(ok) AS accuracy FROM scored JOIN common_id USING (match_id) GROUP BY model)
SELECT model, n, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(accuracy, 6) AS accuracy, round((brier - (SELECT brier FROM s WHERE model = 'market')) * 100 / (SELECT brier FROM s WHERE model = 'market'), 6) AS gap_pct FROM s
""")
def model_comparison(t: Tables) -> DataFrame:
    """Both fitted models, raw and calibrated, beside market, frequencies and uniform over the matches that all predicted."""
    return rounded(RS.comparison(prediction_store(t), MODELS, "market"), "brier", "log_loss", "accuracy", "gap_pct")


@query("model_league_seasons", f"""
WITH RECURSIVE {STORE_SQL},
b AS (SELECT league, season, match_id, max(brier) FILTER (model = 'xg_calibrated') AS score, max(brier) FILTER (model = 'market') AS reference FROM scored GROUP BY ALL)
SELECT league, season, count(*) AS n, round(avg(score), 6) AS brier, round(avg(reference), 6) AS brier_market, round((avg(score) - avg(reference)) * 100 / avg(reference), 6) AS gap_pct FROM b WHERE reference IS NOT NULL GROUP BY ALL
""")
def model_league_seasons(t: Tables) -> DataFrame:
    """The calibrated model against the market by league and season, over matches that both predicted."""
    rows = RS.paired_scores(prediction_store(t), "xg_calibrated", "market")
    out = rows.groupBy("league", "season").agg(F.count("*").alias("n"), F.avg("score").alias("brier"), F.avg("reference").alias("brier_market"))
    return rounded(out.withColumn("gap_pct", (F.col("brier") - F.col("brier_market")) * 100 / F.col("brier_market")), "brier", "brier_market", "gap_pct")


@query("model_verdicts", f"""
WITH RECURSIVE {STORE_SQL},
m AS (SELECT avg(brier) FILTER (model = 'xg_calibrated') AS own, avg(brier) FILTER (model = 'market') AS market, avg(brier) FILTER (model = 'freq') AS freq, avg(brier) FILTER (model = 'uniform') AS unif FROM scored JOIN common_id USING (match_id)),
bins AS (SELECT CAST(floor(p[i + 1] / 0.05) AS INT) AS bin, count(*) AS n, avg(p[i + 1]) AS predicted, avg((outcome = i)::INT) AS observed FROM scored JOIN common_id USING (match_id), (SELECT unnest([0, 1, 2]) AS i) WHERE model = 'xg_calibrated' GROUP BY 1),
c AS (SELECT max(abs(observed - predicted)) AS worst FROM bins WHERE n >= 300)
SELECT 'gap_to_market_pct' AS criterion, round((own - market) / market * 100, 6) AS value, (own - market) / market * 100 < 2 AS passed FROM m
UNION ALL SELECT 'gain_vs_freq', round((freq - own) / freq, 6), (freq - own) / freq >= 0.03 FROM m
UNION ALL SELECT 'gain_vs_uniform', round((unif - own) / unif, 6), (unif - own) / unif >= 0.03 FROM m
UNION ALL SELECT 'worst_calibration_gap', round(worst, 6), worst <= 0.05 FROM c
UNION ALL SELECT 'beats_market_suspect', round(market - own, 6), NOT (own < market) FROM m
""")
def model_verdicts(t: Tables) -> DataFrame:
    """Criterion rows of the calibrated model on the common matches."""
    rows = keep(RS.side_by_side(prediction_store(t), MODELS))
    mean = lambda m: F.avg(brier(F.col("sets")[m], F.col("outcome")))
    means = rows.agg(mean("xg_calibrated").alias("model"), *[mean(m).alias(m) for m in ("market", "freq", "uniform")])
    pairs = M.calibration_pairs(rows, F.col("sets")["xg_calibrated"], F.col("outcome"))
    return rounded(M.backtest_verdicts(means, M.calibration_verdict(M.calibration_table(pairs))), "value")


@query("model_gap_interval")
def model_gap_interval(t: Tables) -> DataFrame:
    """Paired bootstrap of the calibrated model's gap to the market and to the goals-only model, on stored predictions."""
    store, out = keep(prediction_store(t)), None
    for reference in ("market", "goals"):
        rows = RS.paired_scores(store, "xg_calibrated", reference)
        one = R.paired_gap_interval(rows, "score", "reference", "match_id", resamples=B).withColumn("reference", F.lit(reference))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "point", "lo", "hi")


@query("promoted_model_split", f"""
WITH RECURSIVE {STORE_SQL},
squads AS (SELECT DISTINCT league, season, unnest([home, away]) AS team FROM matches_v WHERE fthg IS NOT NULL),
pairs_of AS (SELECT league, season, lag(season) OVER (PARTITION BY league ORDER BY season) AS prev FROM (SELECT DISTINCT league, season FROM squads)),
promoted AS (SELECT s.* FROM squads s JOIN pairs_of p USING (league, season) WHERE prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM squads b WHERE b.league = s.league AND b.season = p.prev AND b.team = s.team)),
r AS (SELECT s.brier AS score, q.brier AS reference, EXISTS (SELECT 1 FROM promoted x WHERE x.league = m.league AND x.season = m.season AND x.team IN (m.home, m.away)) AS promoted
  FROM base m JOIN scored s ON s.match_id = m.match_id AND s.model = 'xg_calibrated' JOIN scored q ON q.match_id = m.match_id AND q.model = 'market')
SELECT promoted, count(*) AS n, round(avg(score), 6) AS brier, round(avg(reference), 6) AS brier_market, round((avg(score) - avg(reference)) * 100 / avg(reference), 6) AS gap_pct FROM r GROUP BY promoted
""")
def promoted_model_split(t: Tables) -> DataFrame:
    """The calibrated model against the market where a promoted team plays, and elsewhere."""
    rows = RS.paired_scores(prediction_store(t), "xg_calibrated", "market").join(t.played.select("match_id", "home", "away"), "match_id")
    return rounded(M.promoted_split(rows, J.promoted(t.played)), "brier", "brier_market", "gap_pct")


# --- leak tests: the same walk-forward on real rows and on rows whose labels moved within their league ---

BOTH_SQL = f"""
r1 AS (SELECT match_id, league, season, date, home, away, row_number() OVER (PARTITION BY league ORDER BY date, match_id) AS rk FROM matches_v WHERE fthg IS NOT NULL),
r2 AS (SELECT league, fthg, ftag, xg_home, xg_away, row_number() OVER (PARTITION BY league ORDER BY {mix_sql(42, 'match_id')}, match_id) AS rk FROM matches_v WHERE fthg IS NOT NULL),
both_rows AS MATERIALIZED (SELECT match_id, 'real:' || league AS league, season, date, home, away, fthg, ftag, xg_home, xg_away FROM matches_v WHERE fthg IS NOT NULL
  UNION ALL SELECT r1.match_id, 'shuffled:' || r1.league, season, date, home, away, fthg, ftag, xg_home, xg_away FROM r1 JOIN r2 ON r1.league = r2.league AND r1.rk = r2.rk)
"""
LABELS = ["fthg", "ftag", "xg_home", "xg_away"]


def both_kinds(played: DataFrame, seed: int = 42) -> DataFrame:
    """Real rows and rows with permuted labels as leagues of their own, so that one job fits both."""
    rows = played.select("match_id", "league", "season", "date", "home", "away", *LABELS)
    mixed = R.permute_within(rows, LABELS, ["league"], ["date", "match_id"], F.col("date"), "match_id", seed)
    tag = lambda df, kind: df.withColumn("league", F.concat(F.lit(f"{kind}:"), F.col("league")))
    return tag(rows, "real").unionByName(tag(mixed, "shuffled"))


def leak_table(scores: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key from rows (keys, league with its kind, score): both means, degraded, and whether all are."""
    kind, league = F.split("league", ":")[0], F.split("league", ":")[1]
    by = scores.groupBy(*keys, league.alias("league")).agg(
        F.avg(F.when(kind == "real", F.col("score"))).alias("brier_real"), F.avg(F.when(kind == "shuffled", F.col("score"))).alias("brier_shuffled"))
    by = by.withColumn("degraded", F.col("brier_shuffled") > F.col("brier_real"))
    every = by.groupBy(*keys).agg(F.bool_and("degraded").alias("all_degraded")) if keys else by.agg(F.bool_and("degraded").alias("all_degraded"))
    return by.join(F.broadcast(every), keys) if keys else by.join(F.broadcast(every))


@query("model_leak_test", f"""
WITH RECURSIVE {BOTH_SQL},
{fit_sql(f'm.season = {LEAK}', SETTINGS, rows='both_rows')},
{forecast_sql(f'm.season = {LEAK}', rows='both_rows')},
s AS (SELECT CASE WHEN cell = 0 THEN 'goals' ELSE 'xg_calibrated' END AS model, split_part(league, ':', 2) AS league, split_part(league, ':', 1) AS kind, {brier_sql(f"CASE WHEN cell = 0 THEN p ELSE {temper_sql('p', TEMPERATURE)} END")} AS b FROM forecast),
d AS (SELECT model, league, avg(b) FILTER (kind = 'real') AS real, avg(b) FILTER (kind = 'shuffled') AS shuffled FROM s GROUP BY ALL)
SELECT model, league, round(real, 6) AS brier_real, round(shuffled, 6) AS brier_shuffled, shuffled > real AS degraded, bool_and(shuffled > real) OVER (PARTITION BY model) AS all_degraded FROM d
""")
def model_leak_test(t: Tables) -> DataFrame:
    """Both goal models refitted through the control season on real and on permuted labels, all in one job."""
    preds = FC.walk_forward(both_kinds(t.played), [LEAK], chosen(SETTINGS))
    goals = is_setting(GOALS_ONLY)
    p = F.when(goals, F.col("model")).otherwise(O.temper(F.col("model"), F.lit(TEMPERATURE)))
    scores = preds.withColumn("score", brier(p, F.col("outcome")))
    scores = scores.select(F.when(goals, F.lit("goals")).otherwise(F.lit("xg_calibrated")).alias("model"), "league", "score")
    return rounded(leak_table(scores, ["model"]), "brier_real", "brier_shuffled")


@query("derived_leak_test")
def derived_leak_test(t: Tables) -> DataFrame:
    """Derived markets of the same refits: Brier per market and league on real and on permuted labels."""
    rows = FC.derived_season_set(both_kinds(t.played).withColumn("ah_line", ((F.col("match_id") % 9) - 4) / 4.0), [LEAK], XI, W_MIX, KAPPA, None)
    scores = rows.select("market", "league", F.pow(F.col("model_p") - F.col("y"), 2.0).alias("score"))
    return rounded(leak_table(scores, ["market"]), "brier_real", "brier_shuffled")
