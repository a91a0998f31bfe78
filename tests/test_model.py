"""Goal model: gradient, recovery, bounds and the time boundary."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsloom.operators import forecasts as FC
from oddsloom.operators import strengths as S


def simulate(seed=7, teams=6, rounds=40, home=1.4):
    rng = np.random.default_rng(seed)
    att, dfc = rng.normal(0, 0.35, teams), rng.normal(0, 0.25, teams)
    att -= np.log(np.mean(np.exp(att)))
    shape = (1, teams, teams)
    n, yh, ya = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    low = {s: np.zeros(shape) for s in S.LOW_SCORES}
    for _ in range(rounds):
        for h in range(teams):
            for a in range(teams):
                if h == a:
                    continue
                gh = rng.poisson(np.exp(att[h] + dfc[a]) * home)
                ga = rng.poisson(np.exp(att[a] + dfc[h]))
                n[0, h, a] += 1
                yh[0, h, a] += gh
                ya[0, h, a] += ga
                if gh <= 1 and ga <= 1:
                    low[f"{gh}{ga}"][0, h, a] += 1
    return att, dfc, home, (n, yh, ya, low)


def penalised(theta, data, kappa):
    """Negative penalised log-likelihood, straight from its definition."""
    n, yh, ya, low = (d[0] if not isinstance(d, dict) else {k: v[0] for k, v in d.items()} for d in data)
    m = n.shape[0]
    att, dfc, edge, rho = theta[:m], theta[m : 2 * m], theta[2 * m], theta[2 * m + 1]
    lh = np.exp(att[:, None] + dfc[None, :] + edge)
    la = np.exp(att[None, :] + dfc[:, None])
    tau = {"00": 1 - lh * la * rho, "01": 1 + lh * rho, "10": 1 + la * rho, "11": (1 - rho) * np.ones_like(lh)}
    ll = (yh * np.log(lh) - n * lh + ya * np.log(la) - n * la).sum()
    ll += sum((low[s] * np.log(tau[s])).sum() for s in low)
    return -ll + kappa * (att @ att + dfc @ dfc)


def test_optimum_is_stationary():
    _, _, _, data = simulate()
    fit = S.fit_batch(*data, kappa=np.array([1.0]))
    m = fit.attack.shape[1]
    # undo the normalisation along the flat direction: the ridge decides the shift
    best, where = np.inf, None
    for c in np.linspace(-0.5, 0.5, 2001):
        v = ((fit.attack[0] + c) ** 2).sum() + ((fit.defence[0] - c) ** 2).sum()
        if v < best:
            best, where = v, c
    theta = np.concatenate([fit.attack[0] + where, fit.defence[0] - where, fit.edge, fit.rho])
    base = penalised(theta, data, 1.0)
    rng = np.random.default_rng(0)
    for _ in range(40):
        step = rng.normal(0, 1e-2, 2 * m + 2)
        step[-1] *= 0.1
        assert penalised(theta + step, data, 1.0) > base - 1e-5
    assert fit.gradient.max() < 1e-8


def test_recovers_known_strengths():
    att, dfc, home, data = simulate(rounds=200)
    fit = S.fit_batch(*data, kappa=np.array([0.5]))
    assert np.abs(fit.attack[0] - att).max() < 0.12
    assert np.exp(fit.edge[0]) == pytest.approx(home, rel=0.06)
    assert np.mean(np.exp(fit.attack[0])) == pytest.approx(1.0)


def test_rho_stays_inside_bounds():
    _, _, _, (n, yh, ya, low) = simulate()
    low = {k: v.copy() for k, v in low.items()}
    low["11"] *= 50  # far more 1-1 draws than independence gives
    fit = S.fit_batch(n, yh, ya, low, kappa=np.array([1.0]))
    assert -0.2 <= fit.rho[0] <= 0.2
    assert fit.rho[0] == pytest.approx(-0.2)


def test_absent_team_keeps_mean_strength():
    _, _, _, (n, yh, ya, low) = simulate()
    pad = lambda x: np.pad(x, ((0, 0), (0, 1), (0, 1)))
    one = S.fit_batch(n, yh, ya, low, kappa=np.array([1.0]))
    two = S.fit_batch(pad(n), pad(yh), pad(ya), {k: pad(v) for k, v in low.items()}, kappa=np.array([1.0]))
    assert np.allclose(one.attack[0], two.attack[0][:-1], atol=1e-7)


def test_future_rows_change_nothing(tables):
    """Perturb everything from a Monday on: forecasts of earlier weeks stay the same."""
    played = tables.played
    cut = F.lit("1999-03-01").cast("date")
    changed = played.withColumn("fthg", F.when(F.col("date") >= cut, F.col("fthg") + 5).otherwise(F.col("fthg")))
    setting = S.grid_settings([0.003], [0.6], [1.0])

    def before(rows):
        out = FC.walk_forward(rows, [1998], setting).filter(F.col("week") <= cut)
        return {r["match_id"]: tuple(r["model"]) for r in out.select("match_id", "model").collect()}

    a, b = before(played), before(changed)
    assert a.keys() == b.keys() and len(a) > 50
    assert all(np.allclose(a[k], b[k], atol=1e-9) for k in a)


def test_guard_fails_on_leak(tables):
    rows = tables.played.withColumn("ref", F.lit("1995-01-01").cast("date"))
    with pytest.raises(Exception, match="reference date"):
        S.guard_before(rows, "date", "ref").agg(F.max("date")).collect()
