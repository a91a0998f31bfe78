"""Odds to fair probabilities, blending and recalibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import odds as O
from ..operators.forecasts import consensus, final_probs, triple_columns
from ..views import Tables
from .registry import query
from .scoring import power_k_sql

ODDS = ("odds_h", "odds_d", "odds_a")
OPEN = ("open_h", "open_d", "open_a")

# Shin by bisection over z in SQL, with the same two fallbacks.
SHIN_STEP = """
list_reduce(list_transform(range(61), lambda i: {{'lo': 0.0::DOUBLE, 'hi': (1 - 1e-9)::DOUBLE}}),
  lambda s, x: CASE WHEN list_sum(list_transform([{h}, {d}, {a}], lambda o: (sqrt(pow((s.lo + s.hi) / 2, 2) + 4 * (1 - (s.lo + s.hi) / 2) / (o * o * ({b}))) - (s.lo + s.hi) / 2) / (2 * (1 - (s.lo + s.hi) / 2)))) > 1
    THEN {{'lo': (s.lo + s.hi) / 2, 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': (s.lo + s.hi) / 2}} END)
"""


def shin_z_sql(h: str, d: str, a: str) -> str:
    step = SHIN_STEP.format(h=h, d=d, a=a, b=f"1/{h} + 1/{d} + 1/{a}")
    return f"(({step}).lo + ({step}).hi) / 2"


FAIR_SQL = f"""
k AS (SELECT *, 1 / odds_h + 1 / odds_d + 1 / odds_a AS b, {power_k_sql('odds_h', 'odds_d', 'odds_a')} AS pk, {shin_z_sql('odds_h', 'odds_d', 'odds_a')} AS z
  FROM matches_v WHERE odds_h IS NOT NULL),
fair AS (SELECT *, [1 / odds_h / b, 1 / odds_d / b, 1 / odds_a / b] AS prop, [pow(odds_h, -pk), pow(odds_d, -pk), pow(odds_a, -pk)] AS powr,
   list_transform([odds_h, odds_d, odds_a], lambda o: (sqrt(z * z + 4 * (1 - z) / (o * o * b)) - z) / (2 * (1 - z))) AS s0 FROM k),
fairs AS (SELECT *, list_transform(s0, lambda v: v / list_sum(s0)) AS shin FROM fair)
"""


def _odds(names=ODDS):
    return F.array(*names)


def _three(expr: str, name: str) -> str:
    return ", ".join(f"round({expr}[{i + 1}], 6) AS {name}_{s}" for i, s in enumerate("hda"))


@query("fair_proportional", f"WITH {FAIR_SQL} SELECT match_id, {_three('prop', 'fair')} FROM fairs")
def fair_proportional(t: Tables) -> DataFrame:
    rows = t.matches.filter("odds_h IS NOT NULL").withColumn("fair", O.fair(_odds(), "proportional"))
    return rows.select("match_id", *triple_columns(rows, "fair"))


@query("fair_power", f"WITH {FAIR_SQL} SELECT match_id, {_three('powr', 'fair')}, round(pk, 6) AS exponent FROM fairs")
def fair_power(t: Tables) -> DataFrame:
    rows = t.matches.filter("odds_h IS NOT NULL").withColumn("fair", O.fair(_odds(), "power"))
    return rows.select("match_id", *triple_columns(rows, "fair"), F.round(O.power_exponent(_odds()), 6).alias("exponent"))


@query("fair_shin", f"WITH {FAIR_SQL} SELECT match_id, {_three('shin', 'fair')} FROM fairs")
def fair_shin(t: Tables) -> DataFrame:
    rows = t.matches.filter("odds_h IS NOT NULL").withColumn("fair", O.fair(_odds(), "shin"))
    return rows.select("match_id", *triple_columns(rows, "fair"))


@query("fair_methods_long", f"""
WITH {FAIR_SQL}, l AS (SELECT league, 'proportional' AS method, prop AS p FROM fairs UNION ALL SELECT league, 'power', powr FROM fairs UNION ALL SELECT league, 'shin', shin FROM fairs)
SELECT league, method, count(*) AS n, round(avg(p[1]), 6) AS home, round(avg(p[2]), 6) AS draw, round(avg(p[3]), 6) AS away FROM l GROUP BY ALL
""")
def fair_methods_long(t: Tables) -> DataFrame:
    """Every method side by side in long form."""
    packed = F.array(*[F.struct(F.lit(m).alias("method"), O.fair(_odds(), m).alias("p")) for m in O.FAIR_METHODS])
    long = t.matches.filter("odds_h IS NOT NULL").select("league", F.inline(packed))
    mean = lambda k, n: F.round(F.avg(F.col("p")[k]), 6).alias(n)
    return long.groupBy("league", "method").agg(F.count("*").alias("n"), mean(0, "home"), mean(1, "draw"), mean(2, "away"))


@query("fair_two_way", """
SELECT match_id, CASE WHEN odds_h IS NOT NULL THEN round((1 / odds_h) / (1 / odds_h + 1 / open_a), 6) END AS p FROM matches_v
""")
def fair_two_way(t: Tables) -> DataFrame:
    return t.matches.select("match_id", F.round(O.fair_two_way(F.col("odds_h"), F.col("open_a")), 6).alias("p"))


@query("market_consensus", """
WITH q AS (SELECT match_id, odds_h AS h, odds_d AS d, odds_a AS a FROM matches_v WHERE odds_h IS NOT NULL UNION ALL SELECT match_id, open_h, open_d, open_a FROM matches_v),
f AS (SELECT match_id, h, d, a, 1/h + 1/d + 1/a AS b FROM q)
SELECT match_id, round(avg(1/h/b), 6) AS market_h, round(avg(1/d/b), 6) AS market_d, round(avg(1/a/b), 6) AS market_a,
  round(max(h), 6) AS best_odds_h, round(max(d), 6) AS best_odds_d, round(max(a), 6) AS best_odds_a, count(*) AS n_books, bool_and(b >= 1 - 1e-6 AND b <= 1.12) AS margins_ok
FROM f GROUP BY match_id
""")
def market_consensus(t: Tables) -> DataFrame:
    """Two books per fixture (closing, opening), each de-margined alone, then averaged."""
    out = consensus(_book_rows(t), ["match_id"], "proportional")
    return out.select("match_id", *triple_columns(out, "market"), *triple_columns(out, "best_odds"), "n_books", "margins_ok")


def _book_rows(t: Tables) -> DataFrame:
    """One odds triple per (match, book); both books come from one pass over the matches."""
    book = lambda names: F.struct(*[F.col(c).alias(o) for c, o in zip(names, ODDS)])
    return t.matches.select("match_id", F.inline(F.array(book(ODDS), book(OPEN))))


@query("margin_checks", """
SELECT match_id, round(1 / odds_h + 1 / odds_d + 1 / odds_a, 6) AS margin, 1 / odds_h + 1 / odds_d + 1 / odds_a BETWEEN 1 - 1e-6 AND 1.05 + 0.07 AS ok FROM matches_v WHERE odds_h IS NOT NULL
""")
def margin_checks(t: Tables) -> DataFrame:
    rows = t.matches.filter("odds_h IS NOT NULL")
    return rows.select("match_id", F.round(O.book_sum(_odds()), 6).alias("margin"), O.margin_ok(_odds()).alias("ok"))


WEIGHT_SQL = "CASE WHEN {age} IS NULL OR {age} <= 1 THEN 0.92 WHEN {age} >= 5 THEN 0.28 ELSE 0.28 + 0.64 * (5 - {age}) / 4.0 END"


@query("freshness_weights", f"""
SELECT match_id, round(CASE WHEN odds < 3 THEN 0.5 ELSE 1 END * {WEIGHT_SQL.format(age='odds_age_days')}, 6) AS weight,
  round(CASE WHEN odds_age_days <= 1 THEN 0.65 WHEN odds_age_days >= 5 THEN 0 WHEN odds_age_days IS NULL THEN NULL ELSE 0.65 * (5 - odds_age_days) / 4.0 END, 6) AS legacy
FROM bets_v
""")
def freshness_weights(t: Tables) -> DataFrame:
    age = F.col("odds_age_days")
    legacy = F.when(age.isNotNull(), O.legacy_weight(age))
    return t.bets.select("match_id", F.round(O.freshness_weight(age, F.col("odds") >= 3), 6).alias("weight"), F.round(legacy, 6).alias("legacy"))


AGED_SQL = """
b AS (SELECT match_id, league, season, fthg, ftag, match_id % 9 AS age, least((match_id % 9) / 7.0, 1) AS f,
   1/odds_h + 1/odds_d + 1/odds_a AS cb, 1/open_h + 1/open_d + 1/open_a AS ob, odds_h, odds_d, odds_a, open_h, open_d, open_a FROM matches_v WHERE odds_h IS NOT NULL),
c AS (SELECT *, [1/odds_h/cb, 1/odds_d/cb, 1/odds_a/cb] AS cl, [1/open_h/ob, 1/open_d/ob, 1/open_a/ob] AS op FROM b),
g AS (SELECT *, [(1-f)*cl[1] + f*op[1], (1-f)*cl[2] + f*op[2], (1-f)*cl[3] + f*op[3]] AS m FROM c)
"""


@query("blended_probabilities", f"""
WITH {AGED_SQL}, w AS (SELECT *, {WEIGHT_SQL.format(age='age')} AS w FROM g)
SELECT match_id, round(w, 6) AS market_weight, round(w * cl[1] + (1 - w) * op[1], 6) AS final_h, round(w * cl[2] + (1 - w) * op[2], 6) AS final_d, round(w * cl[3] + (1 - w) * op[3], 6) AS final_a FROM w
UNION ALL SELECT match_id, 0, round(1/open_h/(1/open_h + 1/open_d + 1/open_a), 6), round(1/open_d/(1/open_h + 1/open_d + 1/open_a), 6), round(1/open_a/(1/open_h + 1/open_d + 1/open_a), 6) FROM matches_v WHERE odds_h IS NULL
""")
def blended_probabilities(t: Tables) -> DataFrame:
    """Closing market blended with an opening-line model by quote age; no market, model alone."""
    rows = t.matches.select(
        "match_id", O.fair(_odds(), "proportional").alias("market"), O.fair(_odds(OPEN), "proportional").alias("model"),
        (F.col("match_id") % 9).alias("odds_age_days"), F.lit(True).alias("margins_ok"),
    )
    out = final_probs(rows)
    return out.select("match_id", F.round("market_weight", 6).alias("market_weight"), *triple_columns(out, "final"))


@query("aged_fair_probabilities", f"WITH {AGED_SQL} SELECT match_id, {_three('m', 'aged')} FROM g")
def aged_fair_probabilities(t: Tables) -> DataFrame:
    rows = t.matches.filter("odds_h IS NOT NULL").withColumn(
        "aged", O.aged_fair(O.fair(_odds(), "proportional"), O.fair(_odds(OPEN), "proportional"), F.col("match_id") % 9)
    )
    return rows.select("match_id", *triple_columns(rows, "aged"))


@query("aged_taken_odds", f"""
WITH {AGED_SQL} SELECT match_id, round(1 / (m[1] * ((1-f)*cb + f*ob)), 6) AS taken_h, round(1 / (m[2] * ((1-f)*cb + f*ob)), 6) AS taken_d, round(1 / (m[3] * ((1-f)*cb + f*ob)), 6) AS taken_a FROM g
""")
def aged_taken_odds(t: Tables) -> DataFrame:
    _, odds = O.aged_taken_odds(
        O.fair(_odds(), "proportional"), O.fair(_odds(OPEN), "proportional"), _odds(), _odds(OPEN), F.col("match_id") % 9
    )
    rows = t.matches.filter("odds_h IS NOT NULL").withColumn("taken", odds)
    return rows.select("match_id", *triple_columns(rows, "taken"))


@query("tempered_probabilities", f"""
WITH {FAIR_SQL}, q AS (SELECT match_id, [pow(prop[1], 1.077), pow(prop[2], 1.077), pow(prop[3], 1.077)] AS q, prop[1] AS p FROM fairs)
SELECT match_id, round(q[1] / list_sum(q), 6) AS cal_h, round(q[2] / list_sum(q), 6) AS cal_d, round(q[3] / list_sum(q), 6) AS cal_a,
  round(pow(p, 1.3) / (pow(p, 1.3) + pow(1 - p, 1.3)), 6) AS binary FROM q
""")
def tempered_probabilities(t: Tables) -> DataFrame:
    rows = t.matches.filter("odds_h IS NOT NULL").withColumn("p", O.fair(_odds(), "proportional")).withColumn(
        "cal", O.temper(F.col("p"), F.lit(1.077))
    )
    return rows.select("match_id", *triple_columns(rows, "cal"), F.round(O.temper_binary(F.col("p")[0], F.lit(1.3)), 6).alias("binary"))


@query("line_movement", f"""
WITH {AGED_SQL}, e AS (SELECT match_id, cl, op, [0.36 - op[1], 0.27 - op[2], 0.37 - op[3]] AS e FROM g), k AS (SELECT *, list_position(e, list_max(e)) AS k FROM e)
SELECT match_id, k - 1 AS issue, round(e[k], 6) AS edge, round(cl[k] - op[k], 6) AS movement, cl[k] - op[k] > 0 AS convergent FROM k WHERE e[k] > 0
""")
def line_movement(t: Tables) -> DataFrame:
    """Best edge of a fixed forecast over the opening line, and where the line went."""
    op, cl = O.fair(_odds(OPEN), "proportional"), O.fair(_odds(), "proportional")
    rows = t.matches.filter("odds_h IS NOT NULL").select("match_id", op.alias("op"), cl.alias("cl"))
    rows = rows.withColumn("e", O.edges(F.array(F.lit(0.36), F.lit(0.27), F.lit(0.37)), F.col("op")))
    k = F.array_position("e", F.array_max("e")).cast("int")
    move = F.get("cl", k - 1) - F.get("op", k - 1)
    return rows.filter(F.array_max("e") > 0).select(
        "match_id", (k - 1).alias("issue"), F.round(F.array_max("e"), 6).alias("edge"), F.round(move, 6).alias("movement"),
        (move > 0).alias("convergent"),
    )
