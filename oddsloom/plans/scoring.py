"""Forecast scores: flagship table, per-forecast scores, calibration, breakdowns, monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import odds as O
from ..functions.outcomes import (
    argmax, binary_brier, brier, correct, log_loss, outcome_index, ranked_score, total_variation,
    uniform,
)
from ..operators import metrics as M
from ..operators.baselines import outcome_frequencies, with_frequency
from ..views import Tables
from .registry import query

# Season roles on the bundled views.
BURN_IN, VALIDATION, TEST, LEAK = (1994, 1995), (1996, 1997), (1998, 1999, 2000), 1998

POWER_SQL = """
list_reduce(list_transform(range(61), lambda i: {{'lo': 0.001::DOUBLE, 'hi': 20.0::DOUBLE}}),
  lambda s, x: CASE WHEN pow({h}, -((s.lo + s.hi) / 2)) + pow({d}, -((s.lo + s.hi) / 2)) + pow({a}, -((s.lo + s.hi) / 2)) > 1
    THEN {{'lo': (s.lo + s.hi) / 2, 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': (s.lo + s.hi) / 2}} END)
"""


def power_k_sql(h: str, d: str, a: str) -> str:
    return (
        f"CASE WHEN abs(1/{h} + 1/{d} + 1/{a} - 1) < 1e-12 THEN 1.0 ELSE "
        f"(({POWER_SQL.format(h=h, d=d, a=a)}).lo + ({POWER_SQL.format(h=h, d=d, a=a)}).hi) / 2 END"
    )


# Earlier H/D/A shares per row of the target seasons, by a plain range join.
FREQ_SQL = f"""
weeks AS (SELECT DISTINCT league, CAST(date_trunc('week', date) AS DATE) AS wk FROM matches_v WHERE fthg IS NOT NULL),
freqs AS (SELECT w.league, w.wk, count(m.match_id) AS n,
    count(*) FILTER (m.fthg > m.ftag) AS n0, count(*) FILTER (m.fthg = m.ftag) AS n1, count(*) FILTER (m.fthg < m.ftag) AS n2
  FROM weeks w LEFT JOIN matches_v m ON m.league = w.league AND m.fthg IS NOT NULL AND m.date < w.wk GROUP BY 1, 2)
"""

FORECAST_SQL = f"""
{FREQ_SQL},
base AS (SELECT m.match_id, m.league, m.season, m.date, m.odds_h, m.odds_d, m.odds_a, m.fthg, m.ftag,
    CASE WHEN m.fthg > m.ftag THEN 0 WHEN m.fthg = m.ftag THEN 1 ELSE 2 END AS outcome,
    CASE WHEN f.n > 0 THEN [f.n0 / f.n, f.n1 / f.n, f.n2 / f.n] ELSE [1/3, 1/3, 1/3] END AS freq,
    {power_k_sql('m.odds_h', 'm.odds_d', 'm.odds_a')} AS k
  FROM matches_v m JOIN freqs f ON f.league = m.league AND f.wk = CAST(date_trunc('week', m.date) AS DATE)
  WHERE m.fthg IS NOT NULL AND m.season IN (1998, 1999, 2000)),
forecasts AS (
  SELECT match_id, league, season, date, outcome, 'market' AS method, [pow(odds_h, -k), pow(odds_d, -k), pow(odds_a, -k)] AS p FROM base WHERE odds_h IS NOT NULL
  UNION ALL SELECT match_id, league, season, date, outcome, 'freq', freq FROM base
  UNION ALL SELECT match_id, league, season, date, outcome, 'uniform', [1/3, 1/3, 1/3] FROM base),
scored AS (SELECT *, (p[1] - (outcome = 0)::INT)**2 + (p[2] - (outcome = 1)::INT)**2 + (p[3] - (outcome = 2)::INT)**2 AS brier,
    -ln(greatest(p[outcome + 1], 1e-12)) AS ll,
    CASE WHEN list_position(p, list_max(p)) - 1 = outcome THEN 1.0 ELSE 0.0 END AS ok FROM forecasts)
"""


def market_forecasts(t: Tables) -> DataFrame:
    """Test rows with market, frequency and uniform triples and the observed outcome."""
    rows = with_frequency(t.played, TEST)
    odds = F.array("odds_h", "odds_d", "odds_a")
    return rows.select(
        "match_id", "league", "season", "date", "odds_h", "odds_d", "odds_a", "odds_source", "fthg", "ftag",
        "freq", outcome_index(F.col("fthg"), F.col("ftag")).alias("outcome"),
        O.fair(odds, "power").alias("market"),
    )


def forecast_methods(t: Tables) -> DataFrame:
    methods = {"market": F.col("market"), "freq": F.col("freq"), "uniform": uniform()}
    return M.long_methods(market_forecasts(t), methods, ["match_id", "league", "season", "date", "outcome"])


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("forecast_method_scores", f"""
WITH {FORECAST_SQL}
SELECT method, coalesce(league, 'all') AS league, coalesce(CAST(season AS VARCHAR), 'all') AS season, count(*) AS n,
  round(avg(brier), 6) AS brier, round(avg(ll), 6) AS log_loss, round(avg(ok), 6) AS accuracy
FROM scored GROUP BY GROUPING SETS ((method), (method, league), (method, league, season))
""")
def forecast_method_scores(t: Tables) -> DataFrame:
    """Flagship: market vs frequency vs uniform, by league and season with sub-totals."""
    return rounded(M.method_rollup(forecast_methods(t)), "brier", "log_loss", "accuracy")


@query("method_table", f"""
WITH {FORECAST_SQL}
SELECT method, count(*) AS n, round(avg(brier), 6) AS brier, round(avg(ll), 6) AS log_loss, round(avg(ok), 6) AS accuracy
FROM scored GROUP BY method
""")
def method_table(t: Tables) -> DataFrame:
    return rounded(M.method_scores(forecast_methods(t)), "brier", "log_loss", "accuracy")


@query("per_forecast_scores", f"""
WITH {FORECAST_SQL}
SELECT match_id, method, round(brier, 6) AS brier, round(ll, 6) AS log_loss, ok AS correct,
  round(((p[1] - (outcome = 0)::INT)**2 + (p[1] + p[2] - (outcome <= 1)::INT)**2) / 2, 6) AS rps
FROM scored
""")
def per_forecast_scores(t: Tables) -> DataFrame:
    p, o = F.col("probs"), F.col("outcome")
    return forecast_methods(t).select(
        "match_id", "method", F.round(brier(p, o), 6).alias("brier"), F.round(log_loss(p, o), 6).alias("log_loss"),
        correct(p, o).alias("correct"), F.round(ranked_score(p, o), 6).alias("rps"),
    )


@query("league_season_gaps", f"""
WITH {FORECAST_SQL}
SELECT league, season, count(*) FILTER (method = 'freq') AS n, round(avg(brier) FILTER (method = 'freq'), 6) AS freq,
  round(avg(brier) FILTER (method = 'market'), 6) AS market, round(avg(brier) FILTER (method = 'uniform'), 6) AS uniform,
  round((avg(brier) FILTER (method = 'freq') - avg(brier) FILTER (method = 'market')) * 100 / avg(brier) FILTER (method = 'market'), 6) AS gap_pct
FROM scored GROUP BY league, season
""")
def league_season_gaps(t: Tables) -> DataFrame:
    """Frequency baseline against the market per league and season, side by side."""
    long = forecast_methods(t)
    wide = M.league_season_gaps(long, model="freq").select("league", "season", "n", "freq", "market", "uniform", "gap_pct")
    return rounded(wide, "freq", "market", "uniform", "gap_pct")


@query("league_log_loss", f"""
WITH {FORECAST_SQL}
SELECT league, round(avg(ll) FILTER (method = 'market'), 6) AS market, round(avg(ll) FILTER (method = 'freq'), 6) AS freq,
  round(avg(ll) FILTER (method = 'uniform'), 6) AS uniform FROM scored GROUP BY league
""")
def league_log_loss(t: Tables) -> DataFrame:
    wide = (
        forecast_methods(t).groupBy("league").pivot("method", ["market", "freq", "uniform"])
        .agg(F.avg(log_loss(F.col("probs"), F.col("outcome"))))
    )
    return rounded(wide, "market", "freq", "uniform")


PAIRS_SQL = f"""{FORECAST_SQL},
pairs AS (SELECT method, p[i + 1] AS p, CASE WHEN outcome = i THEN 1.0 ELSE 0.0 END AS hit
  FROM forecasts, (SELECT unnest([0, 1, 2]) AS i)),
bins AS (SELECT method, CAST(floor(p / 0.05) AS INT) AS bin, count(*) AS n, avg(p) AS predicted, avg(hit) AS observed FROM pairs GROUP BY 1, 2)
"""


@query("calibration_table", f"""
WITH {PAIRS_SQL}
SELECT method, bin, n, round(predicted, 6) AS predicted, round(observed, 6) AS observed, round(observed - predicted, 6) AS gap FROM bins
""")
def calibration_table(t: Tables) -> DataFrame:
    pairs = M.calibration_pairs(forecast_methods(t), F.col("probs"), F.col("outcome"), ["method"])
    return rounded(M.calibration_table(pairs, ["method"]), "predicted", "observed", "gap")


@query("calibration_verdict", f"""
WITH {PAIRS_SQL}
SELECT method, count(*) AS n_bins, arg_max(bin, abs(observed - predicted)) AS worst_bin, round(max(abs(observed - predicted)), 6) AS worst_gap,
  count(*) FILTER (observed < predicted - 0.01) AS n_over, count(*) FILTER (observed > predicted + 0.01) AS n_under,
  max(abs(observed - predicted)) <= 0.05 AS passed
FROM bins WHERE n >= 300 GROUP BY method
""")
def calibration_verdict(t: Tables) -> DataFrame:
    pairs = M.calibration_pairs(forecast_methods(t), F.col("probs"), F.col("outcome"), ["method"])
    table = M.calibration_table(pairs, ["method"])
    return rounded(M.calibration_verdict(table, ["method"]), "worst_gap")


@query("longshot_bias", """
WITH pairs AS (SELECT unnest([(1/odds_h), (1/odds_d), (1/odds_a)]) / (1/odds_h + 1/odds_d + 1/odds_a) AS p,
    unnest([CAST(fthg > ftag AS INT), CAST(fthg = ftag AS INT), CAST(fthg < ftag AS INT)]) AS hit
  FROM matches_v WHERE fthg IS NOT NULL AND odds_h IS NOT NULL)
SELECT count(*) AS n, round(avg(p - hit), 6) AS bias FROM pairs WHERE p < 0.25
""")
def longshot_bias(t: Tables) -> DataFrame:
    """Mean (p - hit) of the unlikely outcomes; 0.25 because these views quote no p below 0.15."""
    rows = t.played.filter("odds_h IS NOT NULL").select(
        outcome_index(F.col("fthg"), F.col("ftag")).alias("o"),
        O.fair(F.array("odds_h", "odds_d", "odds_a"), "proportional").alias("p"),
    )
    pairs = M.calibration_pairs(rows, F.col("p"), F.col("o"))
    return rounded(M.longshot_bias(pairs, below=0.25), "bias")


@query("document_quality_brier", """
WITH s AS (SELECT d.lang, l.quality AS y, CASE WHEN d.doc_id % 7 <> 0 THEN least(0.95, 0.2 + d.n_chars / 8000.0) END AS p
  FROM documents d JOIN labels l USING (doc_id))
SELECT lang, count(p) AS n, round(avg((p - y) ** 2), 6) AS brier, round(avg((0.5 - y) ** 2) FILTER (p IS NOT NULL), 6) AS uniform
FROM s GROUP BY lang
""")
def document_quality_brier(t: Tables) -> DataFrame:
    """Binary Brier on another 0/1 outcome, rows without a probability left out."""
    p = F.when(F.col("doc_id") % 7 != 0, F.least(F.lit(0.95), 0.2 + F.col("n_chars") / 8000.0))
    rows = t.raw("documents").select("doc_id", "lang", "n_chars").join(t.raw("labels"), "doc_id")
    y = F.col("quality")
    return rounded(
        rows.withColumn("p", p).groupBy("lang").agg(
            F.count("p").alias("n"), F.avg(binary_brier(F.col("p"), y)).alias("brier"),
            F.avg(F.when(F.col("p").isNotNull(), binary_brier(F.lit(0.5), y))).alias("uniform"),
        ),
        "brier", "uniform",
    )


@query("document_quality_calibration", """
WITH s AS (SELECT least(0.95, 0.2 + d.n_chars / 8000.0) AS p, l.quality AS hit FROM documents d JOIN labels l USING (doc_id))
SELECT CAST(floor(p / 0.05) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(hit), 6) AS observed, round(avg(hit) - avg(p), 6) AS gap
FROM s GROUP BY 1
""")
def document_quality_calibration(t: Tables) -> DataFrame:
    rows = t.raw("documents").select("doc_id", "n_chars").join(t.raw("labels"), "doc_id")
    pairs = rows.select(F.least(F.lit(0.95), 0.2 + F.col("n_chars") / 8000.0).alias("p"), F.col("quality").alias("hit"))
    return rounded(M.calibration_table(pairs), "predicted", "observed", "gap")


@query("macro_auc", f"""
WITH {FORECAST_SQL},
s AS (SELECT i, p[i + 1] AS score, CAST(outcome = i AS INT) AS y FROM forecasts, (SELECT unnest([0, 1, 2]) AS i) WHERE method = 'market'),
v AS (SELECT i, score, count(*) AS n, sum(y) AS pos FROM s GROUP BY 1, 2),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY i ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rk FROM v),
c AS (SELECT i, sum(rk * pos) AS rs, sum(pos)::DOUBLE AS np, (sum(n) - sum(pos))::DOUBLE AS nn FROM r GROUP BY i)
SELECT count(*) AS n_classes, round(avg((rs - np * (np + 1) / 2) / (np * nn)), 6) AS auc FROM c WHERE np > 0 AND nn > 0
""")
def macro_auc(t: Tables) -> DataFrame:
    rows = forecast_methods(t).filter("method = 'market'")
    return rounded(M.macro_auc(rows, F.col("probs"), F.col("outcome")), "auc")


@query("ex_post_frequencies", """
WITH m AS (SELECT league, CASE WHEN fthg > ftag THEN 0 WHEN fthg = ftag THEN 1 ELSE 2 END AS o FROM matches_v WHERE fthg IS NOT NULL AND season IN (1998, 1999, 2000)),
f AS (SELECT league, count(*) AS n, avg((o = 0)::INT) AS h, avg((o = 1)::INT) AS d, avg((o = 2)::INT) AS a FROM m GROUP BY league)
SELECT f.league, f.n, round(f.h, 6) AS freq_h, round(f.d, 6) AS freq_d, round(f.a, 6) AS freq_a,
  round(avg((h - (o = 0)::INT)**2 + (d - (o = 1)::INT)**2 + (a - (o = 2)::INT)**2), 6) AS brier
FROM f JOIN m USING (league) GROUP BY ALL
""")
def ex_post_frequencies(t: Tables) -> DataFrame:
    """Class shares of the scored rows themselves, and the Brier they would get.

    With shares s the mean Brier is 1 - sum(s^2): one aggregation, nothing is joined back.
    """
    o = outcome_index(F.col("fthg"), F.col("ftag"))
    shares = t.played.filter(F.col("season").isin(*TEST)).groupBy("league").agg(
        F.count("*").alias("n"),
        *[F.avg(F.when(o == k, 1.0).otherwise(0.0)).alias(f"freq_{s}") for k, s in enumerate("hda")],
    )
    gone = sum(F.pow(F.col(f"freq_{s}"), 2.0) for s in "hda")
    return rounded(shares.withColumn("brier", 1.0 - gone), "freq_h", "freq_d", "freq_a", "brier")


@query("disagreement_distance", f"""
WITH {FORECAST_SQL}
SELECT a.match_id, round(0.5 * (abs(a.p[1] - b.p[1]) + abs(a.p[2] - b.p[2]) + abs(a.p[3] - b.p[3])), 6) AS distance
FROM forecasts a JOIN forecasts b USING (match_id) WHERE a.method = 'market' AND b.method = 'freq'
""")
def disagreement_distance(t: Tables) -> DataFrame:
    rows = market_forecasts(t).filter("market IS NOT NULL")
    return rows.select("match_id", F.round(total_variation(F.col("market"), F.col("freq")), 6).alias("distance"))


@query("backtest_verdicts", f"""
WITH {PAIRS_SQL},
m AS (SELECT avg(brier) FILTER (method = 'freq') AS model, avg(brier) FILTER (method = 'market') AS market,
   avg(brier) FILTER (method = 'freq') AS freq, avg(brier) FILTER (method = 'uniform') AS unif FROM scored),
c AS (SELECT max(abs(observed - predicted)) AS worst FROM bins WHERE method = 'freq' AND n >= 300)
SELECT 'gap_to_market_pct' AS criterion, round((model - market) / market * 100, 6) AS value, (model - market) / market * 100 < 2 AS passed FROM m
UNION ALL SELECT 'gain_vs_freq', round((freq - model) / freq, 6), (freq - model) / freq >= 0.03 FROM m
UNION ALL SELECT 'gain_vs_uniform', round((unif - model) / unif, 6), (unif - model) / unif >= 0.03 FROM m
UNION ALL SELECT 'worst_calibration_gap', round(worst, 6), worst <= 0.05 FROM c
UNION ALL SELECT 'beats_market_suspect', round(market - model, 6), NOT (model < market) FROM m
""")
def backtest_verdicts(t: Tables) -> DataFrame:
    """Criterion rows with the frequency forecast in the role of the model."""
    long = forecast_methods(t)
    b = brier(F.col("probs"), F.col("outcome"))
    mean = lambda m: F.avg(F.when(F.col("method") == m, b))
    means = long.agg(
        mean("freq").alias("model"), mean("market").alias("market"), mean("freq").alias("freq"),
        mean("uniform").alias("uniform"),
    )
    pairs = M.calibration_pairs(long.filter("method = 'freq'"), F.col("probs"), F.col("outcome"))
    return rounded(M.backtest_verdicts(means, M.calibration_verdict(M.calibration_table(pairs))), "value")


@query("monthly_monitoring", f"""
WITH {FORECAST_SQL},
j AS (SELECT f.match_id, f.date, f.outcome, f.p AS pf, m.p AS pm FROM forecasts f LEFT JOIN (SELECT * FROM forecasts WHERE method = 'market') m USING (match_id) WHERE f.method = 'freq'),
s AS (SELECT strftime(j.date, '%Y-%m') AS month, j.outcome, pf, pm, list_position(pf, list_max(pf)) - 1 AS pick, b.fthg, b.ftag,
   (pf[1] - (j.outcome = 0)::INT)**2 + (pf[2] - (j.outcome = 1)::INT)**2 + (pf[3] - (j.outcome = 2)::INT)**2 AS bf,
   (pm[1] - (j.outcome = 0)::INT)**2 + (pm[2] - (j.outcome = 1)::INT)**2 + (pm[3] - (j.outcome = 2)::INT)**2 AS bm
   FROM j JOIN base b USING (match_id))
SELECT coalesce(month, 'all') AS month, count(*) AS n, round(avg(bf), 6) AS brier, round(avg(bm), 6) AS brier_market, count(pm) AS n_market,
  round(avg(((pf[1] - (outcome = 0)::INT)**2 + (pf[1] + pf[2] - (outcome <= 1)::INT)**2) / 2), 6) AS rps,
  round(avg((pick = outcome)::INT), 6) AS issue_rate,
  round(avg((CASE pick WHEN 0 THEN '1-0' WHEN 1 THEN '1-1' ELSE '0-1' END = fthg || '-' || ftag)::INT), 6) AS exact_rate,
  round(avg(pf[2]), 6) AS draw_predicted, round(avg((outcome = 1)::INT), 6) AS draw_observed
FROM s GROUP BY ROLLUP (month)
""")
def monthly_monitoring(t: Tables) -> DataFrame:
    pick = argmax(F.col("freq"))
    rows = market_forecasts(t).select(
        "date", "outcome", F.col("freq").alias("probs"), "market", pick.alias("predicted_outcome"),
        F.when(pick == 0, "1-0").when(pick == 1, "1-1").otherwise("0-1").alias("predicted_score"),
        F.concat_ws("-", "fthg", "ftag").alias("actual_score"),
    )
    names = ["brier", "brier_market", "rps", "issue_rate", "exact_rate", "draw_predicted", "draw_observed"]
    return rounded(M.monthly_metrics(rows), *names)
