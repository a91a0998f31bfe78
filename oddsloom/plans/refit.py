"""The strength fit once more, as one SQL statement: the twin that fitted queries are held against.

Another algorithm than the operator's: decayed sums come from a range join of folds and matches, and the optimum of the
penalised likelihood is reached by coordinate steps in a recursive query (attacks, then defences, then home edge and the
low-score term), each a Newton step for the one coordinate with the others held. The direction that moves all attacks up
and all defences down is settled exactly: both sums are equal at the optimum.
"""

from __future__ import annotations

from collections.abc import Sequence

from .. import constants as K

CYCLES = 55


def fit_sql(seasons: str, settings: Sequence[tuple[float, float, float]], rows: str = "matches_v", cycles: int = CYCLES) -> str:
    """CTEs ending in ``strengths`` (league, week, cell, xi, w, kappa, team, attack, defence, home_edge, rho, n_train, n_teams).

    ``seasons``: SQL test on m.season of the folds' seasons. ``settings``: (xi, w, kappa), cell is the place. ``rows``: a table of
    played matches. The statement must begin with WITH RECURSIVE.
    """
    values = ", ".join(f"({i}, {x}::DOUBLE, {w}::DOUBLE, {k}::DOUBLE)" for i, (x, w, k) in enumerate(settings))
    tau = "greatest({}, 1e-10)"
    t00, t01, t10, t11 = (tau.format(x) for x in ("1 - lh * la * rho", "1 + lh * rho", "1 + la * rho", "1 - rho"))
    return f"""
setting AS (SELECT * FROM (VALUES {values}) AS s(cell, xi, w, kappa)),
fold AS MATERIALIZED (SELECT row_number() OVER (ORDER BY league, week, cell) AS fid, * FROM (SELECT DISTINCT m.league, CAST(date_trunc('week', m.date) AS DATE) AS week FROM {rows} m WHERE m.fthg IS NOT NULL AND {seasons}), setting),
pairs AS MATERIALIZED (SELECT fid, any_value(kappa) AS kappa, m.home, m.away, sum(e) AS n, sum(e * ((1 - w) * m.fthg + w * coalesce(m.xg_home, m.fthg))) AS yh, sum(e * ((1 - w) * m.ftag + w * coalesce(m.xg_away, m.ftag))) AS ya,
    sum(CASE WHEN m.fthg = 0 AND m.ftag = 0 THEN 1.0 * e ELSE 0 END) AS c00, sum(CASE WHEN m.fthg = 0 AND m.ftag = 1 THEN 1.0 * e ELSE 0 END) AS c01,
    sum(CASE WHEN m.fthg = 1 AND m.ftag = 0 THEN 1.0 * e ELSE 0 END) AS c10, sum(CASE WHEN m.fthg = 1 AND m.ftag = 1 THEN 1.0 * e ELSE 0 END) AS c11
  FROM (SELECT f.*, m.* EXCLUDE (league), exp(-xi * date_diff('day', m.date, f.week)) AS e FROM fold f JOIN {rows} m ON m.league = f.league AND m.fthg IS NOT NULL AND m.date < f.week) m GROUP BY fid, m.home, m.away),
fit AS (
  SELECT 0 AS it, fid, team, 0.0::DOUBLE AS att, 0.0::DOUBLE AS dfc, 0.0::DOUBLE AS edge, 0.0::DOUBLE AS rho FROM (SELECT fid, home AS team FROM pairs UNION SELECT fid, away FROM pairs)
  UNION ALL
  SELECT it, fid, team, CASE WHEN it % 3 = 2 THEN att + (mean_d - mean_a) / 2 ELSE att END, CASE WHEN it % 3 = 2 THEN dfc - (mean_d - mean_a) / 2 ELSE dfc END, edge, rho
  FROM (SELECT *, avg(att) OVER (PARTITION BY fid) AS mean_a, avg(dfc) OVER (PARTITION BY fid) AS mean_d FROM (
    SELECT s.it + 1 AS it, s.fid, s.team,
      CASE WHEN s.it % 3 = 0 THEN s.att + (g.ga - 2 * g.kappa * s.att) / (g.ia + 2 * g.kappa) ELSE s.att END AS att,
      CASE WHEN s.it % 3 = 1 THEN s.dfc + (g.gd - 2 * g.kappa * s.dfc) / (g.id + 2 * g.kappa) ELSE s.dfc END AS dfc,
      CASE WHEN s.it % 3 = 2 THEN s.edge + o.ge / o.ie ELSE s.edge END AS edge,
      CASE WHEN s.it % 3 = 2 AND o.ir > 0 THEN greatest(-{K.RHO_BOUND}, least({K.RHO_BOUND}, s.rho + o.gr / o.ir)) ELSE s.rho END AS rho
    FROM fit s
    JOIN (SELECT fid, team, any_value(kappa) AS kappa, sum(ga) AS ga, sum(gd) AS gd, sum(ia) AS ia, sum(id) AS id FROM (
        SELECT fid, kappa, unnest([home, away]) AS team, unnest([gh, ga]) AS ga, unnest([ga, gh]) AS gd, unnest([n * lh, n * la]) AS ia, unnest([n * la, n * lh]) AS id FROM (
          SELECT *, yh - n * lh + lh * (c00 / {t00} * (-la * rho) + c01 / {t01} * rho) AS gh, ya - n * la + la * (c00 / {t00} * (-lh * rho) + c10 / {t10} * rho) AS ga
          FROM (SELECT p.*, h.rho, exp(h.att + a.dfc + h.edge) AS lh, exp(a.att + h.dfc) AS la FROM pairs p JOIN fit h ON h.fid = p.fid AND h.team = p.home JOIN fit a ON a.fid = p.fid AND a.team = p.away))) GROUP BY fid, team) g
      ON g.fid = s.fid AND g.team = s.team
    JOIN (SELECT fid, sum(yh - n * lh + lh * (c00 / {t00} * (-la * rho) + c01 / {t01} * rho)) AS ge, sum(n * lh) AS ie,
        sum(c00 / {t00} * (-lh * la) + c01 / {t01} * lh + c10 / {t10} * la - c11 / {t11}) AS gr,
        sum(c00 * pow(lh * la / {t00}, 2) + c01 * pow(lh / {t01}, 2) + c10 * pow(la / {t10}, 2) + c11 / pow({t11}, 2)) AS ir
      FROM (SELECT p.*, h.rho, exp(h.att + a.dfc + h.edge) AS lh, exp(a.att + h.dfc) AS la FROM pairs p JOIN fit h ON h.fid = p.fid AND h.team = p.home JOIN fit a ON a.fid = p.fid AND a.team = p.away) GROUP BY fid) o
      ON o.fid = s.fid
    WHERE s.it < {3 * cycles})) AS moved),
done AS (SELECT *, ln(avg(exp(att)) OVER (PARTITION BY fid)) AS level FROM fit WHERE it = {3 * cycles}),
trained AS (SELECT fid, sum(n) AS n_train FROM pairs GROUP BY fid),
strengths AS MATERIALIZED (SELECT f.league, f.week, f.cell, f.xi, f.w, f.kappa, d.team, att - level AS attack, dfc + level AS defence, edge AS home_edge, rho, n_train, count(*) OVER (PARTITION BY d.fid) AS n_teams,
    ln(avg(exp(att - level)) OVER (PARTITION BY d.fid)) AS attack_mean, ln(avg(exp(dfc + level)) OVER (PARTITION BY d.fid)) AS defence_mean
  FROM done d JOIN fold f USING (fid) JOIN trained USING (fid))"""


def forecast_sql(seasons: str, rows: str = "matches_v", goals: int = K.GRID_GOALS) -> str:
    """CTEs after ``fit_sql``, ending in ``forecast``: match_id, league, season, week, cell, xi, w, kappa, outcome, p (three probabilities), lam_h, lam_a, rho."""
    return f"""
common AS (SELECT DISTINCT league, week, cell, xi, w, kappa, home_edge, rho, attack_mean, defence_mean FROM strengths),
rate AS MATERIALIZED (SELECT m.match_id, m.league, m.season, m.date, c.week, c.cell, c.xi, c.w, c.kappa, m.fthg, m.ftag, c.rho, CASE WHEN m.fthg > m.ftag THEN 0 WHEN m.fthg = m.ftag THEN 1 ELSE 2 END AS outcome,
    exp(coalesce(h.attack, c.attack_mean) + coalesce(a.defence, c.defence_mean) + c.home_edge) AS lam_h, exp(coalesce(a.attack, c.attack_mean) + coalesce(h.defence, c.defence_mean)) AS lam_a
  FROM {rows} m JOIN common c ON c.league = m.league AND c.week = CAST(date_trunc('week', m.date) AS DATE)
  LEFT JOIN strengths h ON h.league = c.league AND h.week = c.week AND h.cell = c.cell AND h.team = m.home
  LEFT JOIN strengths a ON a.league = c.league AND a.week = c.week AND a.cell = c.cell AND a.team = m.away
  WHERE m.fthg IS NOT NULL AND {seasons}),
cell_p AS (SELECT match_id, league, cell, h, a, greatest(exp(h * ln(lam_h) - lam_h - ln(factorial(h::INT)::DOUBLE)) * exp(a * ln(lam_a) - lam_a - ln(factorial(a::INT)::DOUBLE)) *
    CASE WHEN h = 0 AND a = 0 THEN 1 - lam_h * lam_a * rho WHEN h = 0 AND a = 1 THEN 1 + lam_h * rho WHEN h = 1 AND a = 0 THEN 1 + lam_a * rho WHEN h = 1 AND a = 1 THEN 1 - rho ELSE 1 END, 0) AS q
  FROM rate, (SELECT unnest(range({goals + 1})) AS h), (SELECT unnest(range({goals + 1})) AS a)),
triple AS (SELECT match_id, league, cell, [sum(q) FILTER (h > a) / sum(q), sum(q) FILTER (h = a) / sum(q), sum(q) FILTER (h < a) / sum(q)] AS p FROM cell_p GROUP BY match_id, league, cell),
forecast AS MATERIALIZED (SELECT r.*, t.p FROM rate r JOIN triple t USING (match_id, league, cell))"""


def brier_sql(p: str, outcome: str = "outcome") -> str:
    return f"(pow({p}[1] - ({outcome} = 0)::INT, 2) + pow({p}[2] - ({outcome} = 1)::INT, 2) + pow({p}[3] - ({outcome} = 2)::INT, 2))"


def temper_sql(p: str, t: float) -> str:
    """Probabilities in proportion to their powers."""
    powers = f"list_transform({p}, lambda x: pow(x, {t}))"
    return f"list_transform({powers}, lambda x: x / list_sum({powers}))"
