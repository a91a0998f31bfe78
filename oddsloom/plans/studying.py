"""Signal studies on the match views, with the walk-forward frequency forecast as the model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SEED
from ..functions import odds as O
from ..functions.outcomes import outcome_index
from ..operators import features as H
from ..operators import studies as ST
from ..operators import tuning as U
from ..operators.baselines import with_frequency
from ..session import keep
from ..views import Tables
from .featuring import with_stats
from .pricing import FAIR_SQL
from .registry import query
from .resampling import B, draws_sql, ranked_sql
from .scoring import TEST, VALIDATION, rounded

CLOSE, OPEN = ("odds_h", "odds_d", "odds_a"), ("open_h", "open_d", "open_a")
WEIGHTS, THRESHOLDS = [w / 4.0 for w in range(-8, 9)], [x / 100.0 for x in range(21)]


def study_rows(t: Tables, seasons) -> DataFrame:
    """Target rows: frequency triple as model, fair closing and opening triples, both price triples."""
    rows = with_frequency(t.played, seasons).filter("odds_h IS NOT NULL")
    return rows.select(
        "match_id", "season", outcome_index(F.col("fthg"), F.col("ftag")).alias("outcome"), F.col("freq").alias("model"),
        O.fair(F.array(*CLOSE), "proportional").alias("close"), O.fair(F.array(*OPEN), "proportional").alias("open"),
        F.array(*CLOSE).alias("close_odds"), F.array(*OPEN).alias("open_odds"),
    )


ROWS_SQL = """
weeks AS (SELECT DISTINCT league, CAST(date_trunc('week', date) AS DATE) AS wk FROM matches_v WHERE fthg IS NOT NULL),
fq AS (SELECT w.league, w.wk, count(m.match_id) AS n, count(*) FILTER (m.fthg > m.ftag) AS n0, count(*) FILTER (m.fthg = m.ftag) AS n1, count(*) FILTER (m.fthg < m.ftag) AS n2
  FROM weeks w LEFT JOIN matches_v m ON m.league = w.league AND m.fthg IS NOT NULL AND m.date < w.wk GROUP BY 1, 2),
sr AS (SELECT m.match_id, m.season, CASE WHEN m.fthg > m.ftag THEN 0 WHEN m.fthg = m.ftag THEN 1 ELSE 2 END AS o, CASE WHEN f.n > 0 THEN [f.n0 / f.n, f.n1 / f.n, f.n2 / f.n] ELSE [1/3, 1/3, 1/3] END AS md,
   1/odds_h + 1/odds_d + 1/odds_a AS cb, 1/open_h + 1/open_d + 1/open_a AS ob, [odds_h, odds_d, odds_a] AS co, [open_h, open_d, open_a] AS oo
  FROM matches_v m JOIN fq f ON f.league = m.league AND f.wk = CAST(date_trunc('week', m.date) AS DATE) WHERE m.fthg IS NOT NULL AND m.odds_h IS NOT NULL),
sf AS (SELECT *, list_transform(co, lambda x: 1 / x / cb) AS cl, list_transform(oo, lambda x: 1 / x / ob) AS op FROM sr)
"""


@query("margin_method_study", f"""
WITH {FAIR_SQL},
ml AS (SELECT match_id, odds_source = 'pinnacle_close' AS sharp, CASE WHEN fthg > ftag THEN 0 WHEN fthg = ftag THEN 1 ELSE 2 END AS o, powr, unnest([{{'m': 'proportional', 'p': prop}}, {{'m': 'power', 'p': powr}}, {{'m': 'shin', 'p': shin}}]) AS x FROM fairs WHERE fthg IS NOT NULL AND season < 1998),
sc AS (SELECT match_id, CASE WHEN sharp THEN 'sharp' ELSE 'other' END || ':' || x.m AS k, o, x.p AS p, (x.p[1] - (o = 0)::INT)**2 + (x.p[2] - (o = 1)::INT)**2 + (x.p[3] - (o = 2)::INT)**2 AS score,
   (powr[1] - (o = 0)::INT)**2 + (powr[2] - (o = 1)::INT)**2 + (powr[3] - (o = 2)::INT)**2 AS base_, -ln(greatest(x.p[o + 1], 1e-12)) AS loss FROM ml),
lw AS (SELECT k, count(*) AS n_longshots, avg(p - hit) AS bias FROM (SELECT k, unnest(p) AS p, unnest([(o = 0)::INT, (o = 1)::INT, (o = 2)::INT]) AS hit FROM sc) WHERE p < 0.25 GROUP BY k),{ranked_sql('rb', 'sc', 'score, base_', 'k')},{draws_sql('m', 'rb', ['score', 'base_'], SEED, 'k')},
q AS (SELECT k, quantile_cont((score - base_) / base_ * 100, 0.025) AS lo, quantile_cont((score - base_) / base_ * 100, 0.975) AS hi FROM m GROUP BY k)
SELECT split_part(sc.k, ':', 1) AS source, split_part(sc.k, ':', 2) AS method, count(*) AS n, round(avg(score), 6) AS brier, round(avg(loss), 6) AS log_loss, any_value(n_longshots) AS n_longshots, round(any_value(bias), 6) AS bias,
  round((avg(score) - avg(base_)) / avg(base_) * 100, 5) AS point, round(any_value(lo), 5) AS lo, round(any_value(hi), 5) AS hi FROM sc JOIN lw ON lw.k = sc.k JOIN q ON q.k = sc.k GROUP BY sc.k
""")
def margin_method_study(t: Tables) -> DataFrame:
    """De-margin methods before the test seasons, sharp closing lines apart from the rest."""
    rows = t.played.filter("odds_h IS NOT NULL AND season < 1998").select(
        "match_id", outcome_index(F.col("fthg"), F.col("ftag")).alias("outcome"), F.array(*CLOSE).alias("odds"),
        F.when(F.col("odds_source") == "pinnacle_close", "sharp").otherwise("other").alias("source"),
    )
    out = ST.margin_methods(rows, ["source"], resamples=B, longshot_below=0.25).drop("excludes_zero")
    return rounded(rounded(out, "brier", "log_loss", "bias"), "point", "lo", "hi", digits=5)


@query("source_mix", """
SELECT season, coalesce(odds_source, 'none') AS source, count(*) AS n FROM matches_v WHERE fthg IS NOT NULL GROUP BY ALL
""")
def source_mix(t: Tables) -> DataFrame:
    return t.played.groupBy("season", F.coalesce("odds_source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"))


BLEND_SQL = f"""{ROWS_SQL},
ag AS (SELECT season, o, md, age, [(1 - f) * cl[1] + f * op[1], (1 - f) * cl[2] + f * op[2], (1 - f) * cl[3] + f * op[3]] AS mk FROM (SELECT *, least(age / 7.0, 1) AS f FROM sf, (SELECT unnest([0, 1, 3, 5, 7]) AS age))),
wg AS (SELECT age, w, avg((w*mk[1] + (1-w)*md[1] - (o = 0)::INT)**2 + (w*mk[2] + (1-w)*md[2] - (o = 1)::INT)**2 + (w*mk[3] + (1-w)*md[3] - (o = 2)::INT)**2) AS b FROM ag, (SELECT unnest(range(21)) / 20.0 AS w) WHERE season IN (1996, 1997) GROUP BY ALL),
ow AS (SELECT age, arg_min(w, (b, w)) AS oracle_w FROM wg GROUP BY age), fw AS (SELECT arg_min(w, (b, w)) AS fixed_w FROM (SELECT w, avg(b) AS b FROM wg GROUP BY w)),
wt AS (SELECT a.*, CASE WHEN a.age <= 1 THEN 0.92 WHEN a.age >= 5 THEN 0.28 ELSE 0.28 + 0.64 * (5 - a.age) / 4.0 END AS weight, CASE WHEN a.age <= 1 THEN 0.65 WHEN a.age >= 5 THEN 0 ELSE 0.65 * (5 - a.age) / 4.0 END AS lw, ow.oracle_w, fw.fixed_w
  FROM ag a JOIN ow USING (age), fw WHERE a.season IN (1998, 1999, 2000)),
ex AS (SELECT age, oracle_w, fixed_w, weight, lw, unnest([{{'n': 'final', 'w': weight}}, {{'n': 'legacy', 'w': lw}}, {{'n': 'market', 'w': 1.0}}, {{'n': 'model', 'w': 0.0}}, {{'n': 'oracle', 'w': oracle_w}}, {{'n': 'fixed', 'w': fixed_w}}]) AS x, mk, md, o FROM wt),
br AS (SELECT age, any_value(oracle_w) AS oracle_w, any_value(fixed_w) AS fixed_w, any_value(weight) AS weight, any_value(lw) AS legacy_weight, x.n AS name, count(*) AS n, avg((x.w*mk[1] + (1-x.w)*md[1] - (o = 0)::INT)**2 + (x.w*mk[2] + (1-x.w)*md[2] - (o = 1)::INT)**2 + (x.w*mk[3] + (1-x.w)*md[3] - (o = 2)::INT)**2) AS b FROM ex GROUP BY age, x.n),
ba AS (SELECT age, any_value(n) AS n, any_value(weight) AS weight, any_value(legacy_weight) AS legacy_weight, any_value(oracle_w) AS oracle_w, any_value(fixed_w) AS fixed_w, max(b) FILTER (name = 'final') AS final, max(b) FILTER (name = 'legacy') AS legacy, max(b) FILTER (name = 'market') AS market,
  max(b) FILTER (name = 'model') AS model, max(b) FILTER (name = 'oracle') AS oracle, max(b) FILTER (name = 'fixed') AS fixed FROM br GROUP BY age)
"""


@query("blend_by_age", f"""
WITH {BLEND_SQL}
SELECT age, n, round(weight, 6) AS weight, round(legacy_weight, 6) AS legacy_weight, oracle_w, fixed_w, round(final, 6) AS final, round(legacy, 6) AS legacy, round(market, 6) AS market, round(model, 6) AS model, round(oracle, 6) AS oracle, round(fixed, 6) AS fixed,
  round(final - least(market, model), 6) AS excess, final <= legacy + 1e-4 AS no_regression FROM ba
""")
def blend_by_age(t: Tables) -> DataFrame:
    """Blend schedules by quote age; weights tuned on validation seasons, read on test seasons."""
    out = ST.blend_by_age(study_rows(t, VALIDATION), study_rows(t, TEST))
    return rounded(out, "weight", "legacy_weight", "final", "legacy", "market", "model", "oracle", "fixed", "excess")


@query("blend_summary", f"""
WITH {BLEND_SQL}
SELECT round(avg(final), 6) AS final, round(avg(legacy), 6) AS legacy, round(avg(oracle), 6) AS oracle, round(avg(fixed), 6) AS fixed, round(avg(market), 6) AS market, round(max(final - least(market, model)), 6) AS max_excess,
  bool_and(final <= legacy + 1e-4) AS no_regression, round((avg(legacy) - avg(final)) * 100 / avg(legacy), 6) AS gain_pct, round((avg(legacy) - avg(final)) / (avg(legacy) - avg(fixed)), 5) AS share_of_gain FROM ba
""")
def blend_summary(t: Tables) -> DataFrame:
    out = ST.blend_summary(ST.blend_by_age(study_rows(t, VALIDATION), study_rows(t, TEST)))
    return rounded(out, "final", "legacy", "oracle", "fixed", "market", "max_excess", "gain_pct").withColumn("share_of_gain", F.round("share_of_gain", 5))


MOVE_SQL = f"""{ROWS_SQL},
ed AS (SELECT match_id, season, o, oo, op, cl, [md[1] - op[1], md[2] - op[2], md[3] - op[3]] AS e FROM sf),
vb AS (SELECT match_id, season, list_position(e, list_max(e)) AS k, e, op, cl, oo, o FROM ed),
ob_ AS (SELECT match_id, season, e[k] AS edge, cl[k] - op[k] AS movement, CASE WHEN o = k - 1 THEN oo[k] - 1 ELSE -1.0 END AS roi FROM vb WHERE e[k] > 0)
"""


@query("movement_study", f"""
WITH {MOVE_SQL}, tb AS (SELECT *, CASE WHEN movement > 0 THEN 'convergent' ELSE 'divergent' END AS g FROM ob_ WHERE season IN (1996, 1997)), ga AS (SELECT * FROM tb WHERE movement > 0), gb AS (SELECT * FROM tb WHERE movement <= 0),
{ranked_sql('rb', 'tb', 'roi', 'g')},{draws_sql('m', 'rb', ['roi'], SEED, 'g')},{ranked_sql('ba', 'ga', 'roi')},{ranked_sql('bb', 'gb', 'roi')},{draws_sql('ma', 'ba', ['roi'], SEED)},{draws_sql('mb', 'bb', ['roi'], SEED + 1)},
q AS (SELECT g, quantile_cont(roi, 0.025) AS lo, quantile_cont(roi, 0.975) AS hi FROM m GROUP BY g), qd AS (SELECT quantile_cont(ma.roi - mb.roi, 0.025) AS lo, quantile_cont(ma.roi - mb.roi, 0.975) AS hi FROM ma JOIN mb USING (b)),
p AS (SELECT g, count(*) AS n, avg(roi) AS point FROM tb GROUP BY g)
SELECT p.g AS "group", n, round(point, 6) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi, lo > 0 OR hi < 0 AS excludes_zero, NULL::BOOLEAN AS signal FROM p JOIN q USING (g)
UNION ALL SELECT 'difference', (SELECT min(n) FROM p), round((SELECT avg(roi) FROM ga) - (SELECT avg(roi) FROM gb), 6), round(lo, 6), round(hi, 6), lo > 0 OR hi < 0, (lo > 0 OR hi < 0) AND (SELECT avg(roi) FROM ga) > (SELECT avg(roi) FROM gb) FROM qd
""")
def movement_study(t: Tables) -> DataFrame:
    """Value bets at the opening line: does the line follow, and does it pay?"""
    bets = ST.opening_bets(study_rows(t, VALIDATION))
    return rounded(ST.movement_study(bets, resamples=B), "point", "lo", "hi")


@query("taken_price_bets", f"""
WITH {ROWS_SQL}, tk AS (SELECT *, list_transform([1, 2, 3], lambda i: 5 / 7.0 * cl[i] + 2 / 7.0 * op[i]) AS tp, 5 / 7.0 * cb + 2 / 7.0 * ob AS tb FROM sf WHERE season IN (1998, 1999, 2000)),
e AS (SELECT *, list_transform([1, 2, 3], lambda i: md[i] - tp[i]) AS e FROM tk), k AS (SELECT *, list_position(e, list_max(e)) AS k FROM e)
SELECT match_id, k - 1 AS issue, round(e[k], 6) AS edge, round(tp[k] - op[k], 6) AS movement, round(CASE WHEN o = k - 1 THEN 1 / (tp[k] * tb) - 1 ELSE -1 END, 6) AS roi FROM k WHERE e[k] > 0
""")
def taken_price_bets(t: Tables) -> DataFrame:
    """Bets at the price two days before kick-off, movement from the opening to that price."""
    bets = ST.taken_bets(study_rows(t, TEST))
    return rounded(bets.select("match_id", "issue", "edge", "movement", "roi"), "edge", "movement", "roi")


@query("composite_study")
def composite_study(t: Tables) -> DataFrame:
    """Composite score tuned on validation bets and read once on test bets, with a permutation test."""
    grid = U.composite_grid(ST.taken_bets(study_rows(t, VALIDATION)), WEIGHTS, THRESHOLDS)
    best = U.best_composite(grid.withColumn("roi", F.round("roi", 12))).first()  # one row: the frozen setting
    if best is None or best["w"] is None:
        raise ValueError("no grid cell selects enough validation bets")
    bets = ST.taken_bets(study_rows(t, TEST)).select("match_id", "edge", "movement", "roi")
    bets = keep(bets)
    out = ST.composite_run(bets, best["w"], best["threshold"], resamples=B)
    names = ["baseline_roi", "selected_roi", "p_value", "mean_lift", "p95_lift", "real_lift", "difference", "lo", "hi"]
    return rounded(out, *names).withColumns({"w": F.lit(best["w"]), "threshold": F.lit(best["threshold"])})


FATIGUE_SQL = """
rr AS (SELECT match_id, date, CAST(date_trunc('week', date) AS DATE) AS wk, home AS team, TRUE AS is_home FROM matches_v WHERE fthg IS NOT NULL UNION ALL SELECT match_id, date, CAST(date_trunc('week', date) AS DATE), away, FALSE FROM matches_v WHERE fthg IS NOT NULL),
w AS (SELECT team, wk, max(d) OVER (PARTITION BY team ORDER BY wk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (SELECT team, wk, max(date) AS d FROM rr GROUP BY ALL)),
rb AS (SELECT match_id, is_home, CASE WHEN date_diff('day', prev, date) <= 3 THEN 'short' WHEN date_diff('day', prev, date) <= 6 THEN 'normal' ELSE 'long' END AS rest_bucket FROM rr JOIN w USING (team, wk) WHERE prev IS NOT NULL),
rs AS (SELECT r.match_id, rest_bucket, unnest([{'a': CASE WHEN is_home THEN 'home' ELSE 'away' END || '_attack', 'v': CASE WHEN is_home THEN fthg - lam_h ELSE ftag - lam_a END}, {'a': CASE WHEN is_home THEN 'home' ELSE 'away' END || '_defence', 'v': CASE WHEN is_home THEN ftag - lam_a ELSE fthg - lam_h END}]) AS x
  FROM rb r JOIN rates_v m USING (match_id))
"""


def _residuals(t: Tables) -> DataFrame:
    rest = H.rest_before_week(H.team_rows(with_stats(t))).select("match_id", "is_home", "rest_bucket")
    return ST.fatigue_residuals(t.rates.select("match_id", "fthg", "ftag", "lam_h", "lam_a"), rest)


@query("fatigue_table", f"""
WITH {FATIGUE_SQL} SELECT x.a AS axis, rest_bucket, count(*) AS n, round(avg(x.v), 6) AS mean, round(1.96 * stddev_samp(x.v) / sqrt(count(*)), 6) AS half_width FROM rs GROUP BY ALL
""")
def fatigue_table(t: Tables) -> DataFrame:
    """Goals minus expected goals by rest bucket on four axes."""
    return rounded(ST.fatigue_table(_residuals(t)), "mean", "half_width")


@query("fatigue_test", f"""
WITH {FATIGUE_SQL}, s AS (SELECT x.a AS axis, count(*) FILTER (rest_bucket = 'short') AS n_short, count(*) FILTER (rest_bucket <> 'short') AS n_rest, avg(x.v) FILTER (rest_bucket = 'short') AS ms, avg(x.v) FILTER (rest_bucket <> 'short') AS mr,
  var_samp(x.v) FILTER (rest_bucket = 'short') AS vs, var_samp(x.v) FILTER (rest_bucket <> 'short') AS vr FROM rs GROUP BY 1)
SELECT axis, n_short, n_rest, round(ms, 6) AS mean_short, round(mr, 6) AS mean_rest, round(CASE WHEN n_short > 5 AND n_rest > 5 THEN ms - mr END, 6) AS difference, round(CASE WHEN n_short > 5 AND n_rest > 5 THEN (ms - mr) / sqrt(vs / n_short + vr / n_rest) END, 6) AS z,
  CASE WHEN n_short > 5 AND n_rest > 5 THEN abs((ms - mr) / sqrt(vs / n_short + vr / n_rest)) > 1.96 END AS significant FROM s
""")
def fatigue_test(t: Tables) -> DataFrame:
    return rounded(ST.fatigue_test(_residuals(t)), "mean_short", "mean_rest", "difference", "z")


DIS_SQL = f"""{ROWS_SQL},
dd AS (SELECT match_id, o, 0.5 * (abs(md[1] - op[1]) + abs(md[2] - op[2]) + abs(md[3] - op[3])) AS distance, (md[1] - (o = 0)::INT)**2 + (md[2] - (o = 1)::INT)**2 + (md[3] - (o = 2)::INT)**2 AS score, [md[1]/cl[1] - 1, md[2]/cl[2] - 1, md[3]/cl[3] - 1] AS e, cl FROM sf WHERE season IN (1998, 1999, 2000)),
dr AS (SELECT match_id, distance, score, list_max(e) AS best_edge, CASE WHEN list_position(e, list_max(e)) - 1 = o THEN 1 / cl[list_position(e, list_max(e))] - 1 ELSE -1.0 END AS roi FROM dd),
md_ AS (SELECT list_sort(list(distance))[CAST(floor(count(*) / 2) AS INT) + 1] AS a, list_sort(list(distance) FILTER (best_edge > 0.03))[CAST(floor(count(*) FILTER (best_edge > 0.03) / 2) AS INT) + 1] AS b FROM dr)
"""


@query("disagreement_study", f"""
WITH {DIS_SQL},
l1 AS (SELECT match_id, score FROM dr, md_ WHERE distance <= a), h1 AS (SELECT match_id, score FROM dr, md_ WHERE distance > a), l2 AS (SELECT match_id, roi FROM dr, md_ WHERE best_edge > 0.03 AND distance <= b), h2 AS (SELECT match_id, roi FROM dr, md_ WHERE best_edge > 0.03 AND distance > b),
{ranked_sql('bl1', 'l1', 'score')},{ranked_sql('bh1', 'h1', 'score')},{ranked_sql('bl2', 'l2', 'roi')},{ranked_sql('bh2', 'h2', 'roi')},
{draws_sql('mh1', 'bh1', ['score'], SEED)},{draws_sql('ml1', 'bl1', ['score'], SEED + 1)},{draws_sql('mh2', 'bh2', ['roi'], SEED)},{draws_sql('ml2', 'bl2', ['roi'], SEED + 1)},
q1 AS (SELECT quantile_cont(mh1.score - ml1.score, 0.025) AS lo, quantile_cont(mh1.score - ml1.score, 0.975) AS hi FROM mh1 JOIN ml1 USING (b)), q2 AS (SELECT quantile_cont(mh2.roi - ml2.roi, 0.025) AS lo, quantile_cont(mh2.roi - ml2.roi, 0.975) AS hi FROM mh2 JOIN ml2 USING (b)),
s AS (SELECT 'brier' AS angle, (SELECT count(*) FROM l1) AS n_low, (SELECT count(*) FROM h1) AS n_high, (SELECT avg(score) FROM l1) AS mean_low, (SELECT avg(score) FROM h1) AS mean_high, lo, hi FROM q1
  UNION ALL SELECT 'value_roi', (SELECT count(*) FROM l2), (SELECT count(*) FROM h2), (SELECT avg(roi) FROM l2), (SELECT avg(roi) FROM h2), lo, hi FROM q2)
SELECT angle, n_low, n_high, round(mean_low, 6) AS mean_low, round(mean_high, 6) AS mean_high, round(mean_high - mean_low, 6) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi, lo > 0 OR hi < 0 AS excludes_zero, CASE WHEN angle = 'value_roi' THEN (lo > 0 OR hi < 0) AND mean_high < mean_low END AS signal FROM s
""")
def disagreement_study(t: Tables) -> DataFrame:
    """Frequency model against an opening-line model: does disagreement predict bad bets?"""
    rows = study_rows(t, TEST).select("match_id", "outcome", F.col("model").alias("first"), F.col("open").alias("second"), F.col("close").alias("market"))
    return rounded(ST.disagreement_study(ST.disagreement_rows(rows), resamples=B), "mean_low", "mean_high", "point", "lo", "hi")
