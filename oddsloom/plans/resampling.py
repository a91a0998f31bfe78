"""Bootstrap intervals, permutations and two-sample statistics on the forecast scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PERMUTATIONS, RESAMPLES, SEED
from ..functions.mixing import MASK, finalise_sql, mix_sql
from ..functions.outcomes import brier, outcome_index
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import resample as R
from ..operators.resample import BLOCK_ROWS, STEPS
from ..session import keep
from ..views import Tables
from .joining import SQUAD_SQL, squad_matches
from .registry import query
from .scoring import FORECAST_SQL, market_forecasts, rounded

B = RESAMPLES


def scored_pairs(t: Tables) -> DataFrame:
    """Test rows with the Brier of the frequency forecast and of the market."""
    rows = market_forecasts(t)
    # kept: points and draws read the rows several times, and a filter on b_market would solve the margins anew each time
    return keep(rows.select(
        "match_id", "league", "date", "outcome", brier(F.col("freq"), F.col("outcome")).alias("b_freq"),
        F.when(F.col("market").isNotNull(), brier(F.col("market"), F.col("outcome"))).alias("b_market"),
    ))


PAIRS = f"""{FORECAST_SQL},
pairs AS (SELECT match_id, any_value(league) AS league, any_value(outcome) AS outcome, max(brier) FILTER (method = 'freq') AS b_freq, max(brier) FILTER (method = 'market') AS b_market FROM scored WHERE method <> 'uniform' GROUP BY match_id)
"""


def ranked_sql(name: str, source: str, cols: str, keys: str = "") -> str:
    """The rows of ``source`` that replicates weigh, in SQL; ``pos`` is the hashed id."""
    k = f"{keys}, " if keys else ""
    return f"""
{name} AS (SELECT {k}{cols}, match_id AS pos FROM {source})"""


def draws_sql(name: str, base: str, cols: list[str], seed: int, keys: str = "", b: int = B) -> str:
    """Weighted mean of each column per replicate, in SQL: Poisson weights of hash(seed, b, id)."""
    k = f"{keys}, " if keys else ""
    weight = " + ".join(f"(h >= {step})::DOUBLE" for step in STEPS)
    means = ", ".join(f"sum(w * {c}) / nullif(sum(w), 0) AS {c}" for c in cols)
    return f"""
{name}_s AS (SELECT b, {mix_sql(seed, 'b')} AS s FROM (SELECT unnest(range({b})) AS b)),
{name}_h AS (SELECT {k}b, {', '.join(cols)}, {finalise_sql(f"((s + (pos & {MASK})) & {MASK})")} AS h FROM {base}, {name}_s),
{name} AS (SELECT {k}b, {means} FROM (SELECT *, {weight} AS w FROM {name}_h) GROUP BY ALL)"""


@query("bootstrap_mean", f"""
WITH {PAIRS},{ranked_sql('rb', 'pairs', 'b_freq', 'league')},{draws_sql('m', 'rb', ['b_freq'], SEED, 'league')}
SELECT p.league, p.n, round(p.point, 6) AS point, round(quantile_cont(m.b_freq, 0.025), 6) AS lo, round(quantile_cont(m.b_freq, 0.975), 6) AS hi, TRUE AS excludes_zero
FROM (SELECT league, count(*) AS n, avg(b_freq) AS point FROM pairs GROUP BY league) p JOIN m ON m.league = p.league GROUP BY ALL
""")
def bootstrap_mean(t: Tables) -> DataFrame:
    """Interval of the mean Brier per league."""
    return rounded(R.mean_interval(scored_pairs(t), "b_freq", "match_id", ["league"], resamples=B), "point", "lo", "hi")


@query("bootstrap_paired_gap", f"""
WITH {PAIRS}, both_ AS (SELECT * FROM pairs WHERE b_market IS NOT NULL),{ranked_sql('rb', 'both_', 'b_freq, b_market')},{draws_sql('m', 'rb', ['b_freq', 'b_market'], SEED)},
q AS (SELECT quantile_cont((b_freq - b_market) / b_market * 100, 0.025) AS lo, quantile_cont((b_freq - b_market) / b_market * 100, 0.975) AS hi FROM m)
SELECT count(*) AS n, round((avg(b_freq) - avg(b_market)) / avg(b_market) * 100, 6) AS point, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi, any_value(lo > 0 OR hi < 0) AS excludes_zero FROM both_, q
""")
def bootstrap_paired_gap(t: Tables) -> DataFrame:
    """Relative gap of the frequency forecast to the market, same rows drawn for both."""
    rows = scored_pairs(t).filter("b_market IS NOT NULL")
    return rounded(R.paired_gap_interval(rows, "b_freq", "b_market", "match_id", resamples=B), "point", "lo", "hi")


@query("bootstrap_gap_difference", f"""
WITH {PAIRS}, ga AS (SELECT * FROM pairs WHERE b_market IS NOT NULL AND league = 'E0'), gb AS (SELECT * FROM pairs WHERE b_market IS NOT NULL AND league <> 'E0'),
{ranked_sql('ba', 'ga', 'b_freq, b_market')},{ranked_sql('bb', 'gb', 'b_freq, b_market')},{draws_sql('ma', 'ba', ['b_freq', 'b_market'], SEED)},{draws_sql('mb', 'bb', ['b_freq', 'b_market'], SEED + 1)},
d AS (SELECT (ma.b_freq - ma.b_market) / ma.b_market * 100 - (mb.b_freq - mb.b_market) / mb.b_market * 100 AS v FROM ma JOIN mb USING (b)),
q AS (SELECT quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM d),
p AS (SELECT least((SELECT count(*) FROM ga), (SELECT count(*) FROM gb)) AS n, (SELECT (avg(b_freq) - avg(b_market)) / avg(b_market) * 100 FROM ga) - (SELECT (avg(b_freq) - avg(b_market)) / avg(b_market) * 100 FROM gb) AS point)
SELECT n, round(point, 6) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi, lo > 0 OR hi < 0 AS excludes_zero FROM p, q
""")
def bootstrap_gap_difference(t: Tables) -> DataFrame:
    """Gap of one league against the gap of the others."""
    rows = scored_pairs(t).filter("b_market IS NOT NULL")
    a, b = rows.filter("league = 'E0'"), rows.filter("league <> 'E0'")
    return rounded(R.gap_difference_interval(a, b, "b_freq", "b_market", "match_id", resamples=B), "point", "lo", "hi")


@query("bootstrap_mean_difference", f"""
WITH {PAIRS}, ga AS (SELECT * FROM pairs WHERE outcome = 0), gb AS (SELECT * FROM pairs WHERE outcome <> 0),
{ranked_sql('ba', 'ga', 'b_freq')},{ranked_sql('bb', 'gb', 'b_freq')},{draws_sql('ma', 'ba', ['b_freq'], SEED)},{draws_sql('mb', 'bb', ['b_freq'], SEED + 1)},
q AS (SELECT quantile_cont(ma.b_freq - mb.b_freq, 0.025) AS lo, quantile_cont(ma.b_freq - mb.b_freq, 0.975) AS hi FROM ma JOIN mb USING (b)),
p AS (SELECT least((SELECT count(*) FROM ga), (SELECT count(*) FROM gb)) AS n, (SELECT avg(b_freq) FROM ga) - (SELECT avg(b_freq) FROM gb) AS point)
SELECT n, round(point, 6) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi, lo > 0 OR hi < 0 AS excludes_zero FROM p, q
""")
def bootstrap_mean_difference(t: Tables) -> DataFrame:
    rows = scored_pairs(t)
    a, b = rows.filter("outcome = 0"), rows.filter("outcome <> 0")
    return rounded(R.difference_interval(a, b, "b_freq", "match_id", resamples=B), "point", "lo", "hi")


SHUFFLED = f"""
r1 AS (SELECT match_id, league, season, date, home, away, row_number() OVER (PARTITION BY league ORDER BY date, match_id) AS rk FROM matches_v WHERE fthg IS NOT NULL),
r2 AS (SELECT league, fthg, ftag, xg_home, row_number() OVER (PARTITION BY league ORDER BY {mix_sql(42, 'match_id')}, match_id) AS rk FROM matches_v WHERE fthg IS NOT NULL),
mixed AS (SELECT r1.*, r2.fthg, r2.ftag, r2.xg_home FROM r1 JOIN r2 USING (league, rk))
"""


def shuffled_labels(t: Tables) -> DataFrame:
    """Scores and xG moved together between the matches of a league."""
    return R.permute_within(
        t.played, ["fthg", "ftag", "xg_home", "xg_away"], ["league"], ["date", "match_id"], F.col("date"), "match_id", 42
    )


@query("label_shuffle", f"WITH {SHUFFLED} SELECT match_id, league, home, away, fthg, ftag, round(xg_home, 6) AS xg_home FROM mixed")
def label_shuffle(t: Tables) -> DataFrame:
    return shuffled_labels(t).select("match_id", "league", "home", "away", "fthg", "ftag", F.round("xg_home", 6).alias("xg_home"))


@query("shuffle_leak_test", f"""
WITH {SHUFFLED}, t AS (SELECT league, home, CASE WHEN fthg > ftag THEN 1.0 ELSE 0.0 END AS y, 'real' AS kind, date FROM matches_v WHERE fthg IS NOT NULL
  UNION ALL SELECT league, home, CASE WHEN fthg > ftag THEN 1.0 ELSE 0.0 END, 'shuffled', date FROM mixed),
rate AS (SELECT kind, league, home, avg(y) AS p FROM t WHERE date < DATE '1998-07-01' GROUP BY ALL),
b AS (SELECT t.kind, t.league, avg((p - y) ** 2) AS brier FROM t JOIN rate USING (kind, league, home) WHERE t.date >= DATE '1998-07-01' AND t.date < DATE '1999-07-01' GROUP BY ALL)
SELECT league, round(max(brier) FILTER (kind = 'real'), 6) AS brier_real, round(max(brier) FILTER (kind = 'shuffled'), 6) AS brier_shuffled, max(brier) FILTER (kind = 'shuffled') > max(brier) FILTER (kind = 'real') AS degraded FROM b GROUP BY league
""")
def shuffle_leak_test(t: Tables) -> DataFrame:
    """Team home-win rates scored on the control season, on real and on permuted labels."""
    tag = lambda df, k: df.select("league", "home", "date", F.when(F.col("fthg") > F.col("ftag"), 1.0).otherwise(0.0).alias("y"), F.lit(k).alias("kind"))
    rows = tag(t.played, "real").unionByName(tag(shuffled_labels(t), "shuffled"))
    rate = rows.filter("date < DATE '1998-07-01'").groupBy("kind", "league", "home").agg(F.avg("y").alias("p"))
    season = rows.filter("date >= DATE '1998-07-01' AND date < DATE '1999-07-01'").join(rate, ["kind", "league", "home"])
    by = season.groupBy("league").pivot("kind", ["real", "shuffled"]).agg(F.avg(F.pow(F.col("p") - F.col("y"), 2.0)))
    return rounded(
        by.select("league", F.col("real").alias("brier_real"), F.col("shuffled").alias("brier_shuffled"), (F.col("shuffled") > F.col("real")).alias("degraded")),
        "brier_real", "brier_shuffled",
    )


BETS = """
bets AS (SELECT match_id, 0.05 + 0.1 * ((match_id % 17) / 17.0 - 0.5) AS edge, 1 / odds_h - 1 / open_h AS movement, CASE WHEN fthg > ftag THEN open_h - 1 ELSE -1.0 END AS roi
  FROM matches_v WHERE fthg IS NOT NULL AND odds_h IS NOT NULL)
"""


def movement_bets(t: Tables) -> DataFrame:
    edge = 0.05 + 0.1 * ((F.col("match_id") % 17) / 17.0 - 0.5)
    return t.played.filter("odds_h IS NOT NULL").select(
        "match_id", "season", edge.alias("edge"), (1.0 / F.col("odds_h") - 1.0 / F.col("open_h")).alias("movement"),
        F.when(F.col("fthg") > F.col("ftag"), F.col("open_h") - 1.0).otherwise(-1.0).alias("roi"),
    )


@query("permutation_p_value", f"""
WITH {BETS}, base AS (SELECT *, {mix_sql(0, 'match_id')} % greatest(1, ceil((SELECT count(*) FROM bets) / {BLOCK_ROWS})::BIGINT) AS blk FROM bets),
fixed AS (SELECT *, row_number() OVER (PARTITION BY blk ORDER BY match_id) AS r FROM base),
moved AS (SELECT b, blk, movement, row_number() OVER (PARTITION BY b, blk ORDER BY {mix_sql(SEED, 'b', 'match_id')}, match_id) AS r FROM base, (SELECT unnest(range({PERMUTATIONS})) AS b)),
l AS (SELECT b, avg(f.roi) AS roi FROM moved m JOIN fixed f USING (blk, r) WHERE f.edge + 0.5 * m.movement > 0.05 GROUP BY b),
o AS (SELECT count(*) AS n, count(*) FILTER (edge + 0.5 * movement > 0.05) AS n_selected, avg(roi) AS baseline_roi, avg(roi) FILTER (edge + 0.5 * movement > 0.05) AS selected_roi FROM base)
SELECT n, n_selected, round(baseline_roi, 6) AS baseline_roi, round(selected_roi, 6) AS selected_roi, count(*) AS n_effective, round(avg((roi - baseline_roi >= selected_roi - baseline_roi)::INT), 6) AS p_value,
  round(avg(roi - baseline_roi), 6) AS mean_lift, round(quantile_cont(roi - baseline_roi, 0.95), 6) AS p95_lift, round(selected_roi - baseline_roi, 6) AS real_lift FROM l, o GROUP BY n, n_selected, o.baseline_roi, o.selected_roi
""")
def permutation_p_value(t: Tables) -> DataFrame:
    out = R.permutation_lift(movement_bets(t), 0.5, 0.05, "match_id")
    return rounded(out, "baseline_roi", "selected_roi", "p_value", "mean_lift", "p95_lift", "real_lift")


@query("welch_by_market", """
WITH r AS (SELECT league, CAST(fthg AS DOUBLE) - lam_h AS x, match_id % 5 = 0 AS short FROM rates_v WHERE fthg IS NOT NULL),
s AS (SELECT league, count(*) FILTER (short) AS n_short, count(*) FILTER (NOT short) AS n_rest, avg(x) FILTER (short) AS ms, avg(x) FILTER (NOT short) AS mr, var_samp(x) FILTER (short) AS vs, var_samp(x) FILTER (NOT short) AS vr FROM r GROUP BY league)
SELECT league, n_short, n_rest, round(ms, 6) AS mean_short, round(mr, 6) AS mean_rest, round(ms - mr, 6) AS difference, round((ms - mr) / sqrt(vs / n_short + vr / n_rest), 6) AS z, abs((ms - mr) / sqrt(vs / n_short + vr / n_rest)) > 1.96 AS significant FROM s
""")
def welch_by_market(t: Tables) -> DataFrame:
    rows = t.rates.filter("fthg IS NOT NULL").select("league", (F.col("fthg") - F.col("lam_h")).alias("x"), (F.col("match_id") % 5 == 0).alias("short"))
    return rounded(R.welch(rows, "x", F.col("short"), ["league"]), "mean_short", "mean_rest", "difference", "z")


@query("median_split", """
WITH r AS (SELECT match_id, 1 / (open_h + 0.1) AS x, fthg FROM matches_v WHERE fthg IS NOT NULL), m AS (SELECT list_sort(list(x))[CAST(floor(count(*) / 2) AS INT) + 1] AS med FROM r)
SELECT CASE WHEN x <= med THEN 'low' ELSE 'high' END AS half, count(*) AS n, round(any_value(med), 6) AS median, round(avg(fthg), 6) AS goals FROM r, m GROUP BY 1
""")
def median_split(t: Tables) -> DataFrame:
    rows = t.played.select("match_id", (1.0 / (F.col("open_h") + 0.1)).alias("x"), "fthg")
    split = R.median_split(rows, "x", "match_id", F.floor(F.col("x") * 4096))
    return rounded(split.groupBy("half").agg(F.count("*").alias("n"), F.max("median").alias("median"), F.avg("fthg").alias("goals")), "median", "goals")


@query("promoted_brier_split", f"""
WITH {SQUAD_SQL}, {PAIRS},
r AS (SELECT p.b_freq, p.b_market, EXISTS (SELECT 1 FROM promoted x WHERE x.league = m.league AND x.season = m.season AND x.team IN (m.home, m.away)) AS promoted
  FROM pairs p JOIN matches_v m USING (match_id))
SELECT promoted, count(*) AS n, round(avg(b_freq), 6) AS brier, round(avg(b_market), 6) AS brier_market,
  round((avg(b_freq) FILTER (b_market IS NOT NULL) - avg(b_market)) * 100 / avg(b_market), 6) AS gap_pct FROM r GROUP BY promoted
""")
def promoted_brier_split(t: Tables) -> DataFrame:
    """Frequency forecast against the market where a promoted team plays, and elsewhere."""
    teams = t.matches.select("match_id", "season", "home", "away")
    rows = scored_pairs(t).select("match_id", "league", F.col("b_freq").alias("score"), F.col("b_market").alias("reference")).join(teams, "match_id")
    return rounded(M.promoted_split(rows, J.promoted(squad_matches(t))), "brier", "brier_market", "gap_pct")
