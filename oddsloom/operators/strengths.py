"""Attack/defence strengths for every fold at once.

A fold is (league, Monday); a setting is (xi, w, kappa). The likelihood of a fold depends on its
training rows only through decayed sums per (home, away) pairing, and exp(-xi * age) factors over
time. So rows collapse once per (league, day, pairing) with a map-side combine, running sums carry
the pairings through the calendar, and each fold's fit works on one row per pairing: its size is
bounded by the square of the team list, whatever the number of matches. Fits are independent and
Spark spreads them by key; numpy solves a year of folds in one batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import KAPPA_DEFAULT, RHO_BOUND, TAU_FLOOR
from ..functions.calendar import monday
from ..session import spread
from .baselines import with_week

ANCHOR = "2000-01-03"  # any fixed Monday: decay factors are relative to it
LOW_SCORES = ("00", "01", "10", "11")
BATCH_CELLS = 100_000  # matrix cells solved together
SUMS = ("n", "gh", "ga", "xh", "xa", *[f"c{s}" for s in LOW_SCORES])
SETTING = ("xi", "w", "kappa")
FIT_KEYS = ("league", "week", *SETTING)

STRENGTH_SCHEMA = (
    "league string, week date, xi double, w double, kappa double, team string, attack double, defence double, "
    "home_edge double, rho double, attack_mean double, defence_mean double, steps int, max_gradient double, "
    "n_train double, n_teams int"
)


class Setting(NamedTuple):
    """One point of the hyper-parameter grid; ``cell`` is its place in grid order."""

    cell: int
    xi: float
    w: float
    kappa: float


def grid_settings(
    xi: Sequence[float], w: Sequence[float] = (0.0,), kappa: Sequence[float] = (KAPPA_DEFAULT,)
) -> list[Setting]:
    points = [(x, y, k) for y in w for x in xi for k in kappa]
    return [Setting(i, float(x), float(y), float(k)) for i, (x, y, k) in enumerate(points)]


def settings_frame(spark: SparkSession, settings: Sequence[Setting]) -> DataFrame:
    return spark.createDataFrame([tuple(s) for s in settings], "cell int, xi double, w double, kappa double")


def target_folds(played: DataFrame, seasons: Sequence) -> DataFrame:
    """Distinct (league, week) of the target seasons."""
    return with_week(played.filter(F.col("season").isin(list(seasons)))).select("league", "week").distinct()


def pairing_days(played: DataFrame) -> DataFrame:
    """Training sums per (league, date, home, away): goals, pseudo-goals and low-score counts.

    The low-score term uses real scores; a missing xG value falls back to the goals of that side.
    """
    h, a = F.col("fthg"), F.col("ftag")
    case = {s: F.sum(F.when((h == int(s[0])) & (a == int(s[1])), 1.0).otherwise(0.0)) for s in LOW_SCORES}
    return played.groupBy("league", "date", "home", "away").agg(
        F.count("*").cast("double").alias("n"),
        F.sum(h.cast("double")).alias("gh"), F.sum(a.cast("double")).alias("ga"),
        F.sum(F.coalesce("xg_home", h.cast("double"))).alias("xh"),
        F.sum(F.coalesce("xg_away", a.cast("double"))).alias("xa"),
        *[e.alias(f"c{s}") for s, e in case.items()],
    )


def decay(xi: Column, reference: Column, day: Column) -> Column:
    """Weight of a training day seen from the reference day."""
    return F.exp(-xi * F.datediff(reference, day))


LATE = "training row on or after the reference date"


def guard_before(df: DataFrame, day: str, reference: str) -> DataFrame:
    """Fail the job when a training day is not before the reference: nothing may leak."""
    ok = F.col(day) < F.col(reference)
    return df.withColumn(day, F.when(ok, F.col(day)).otherwise(F.raise_error(F.lit(LATE)).cast("date")))


def guard_sums(run: DataFrame, last_day: str, reference: str, value: str) -> DataFrame:
    """The same for sums: ``value`` can't be read where the last day that went into it isn't before the reference (NULL: no day did)."""
    ok = F.col(last_day).isNull() | (F.col(last_day) < F.col(reference))
    return run.withColumn(value, F.when(ok, F.col(value)).otherwise(F.raise_error(F.lit(LATE)).cast("double")))


def fold_sums(played: DataFrame, folds: DataFrame, xis: Sequence[float]) -> DataFrame:
    """(league, week, xi, home, away) + decayed sums over all days before the fold's Monday.

    Running sums replace the fold x match range join: daily sums meet the fold marks on one time
    axis per pairing, and the mark reads what came before it.
    """
    days = pairing_days(played)
    anchor = F.lit(ANCHOR).cast("date")
    grow = F.exp(F.col("xi") * F.datediff("week", anchor))
    # within a week all days share the exact weight of their own day, relative to the anchor
    weekly = (
        days.withColumn("xi", F.explode(F.array(*[F.lit(float(x)) for x in xis])))
        .withColumn("week", monday(F.col("date")))
        .groupBy("league", "xi", "home", "away", "week")
        .agg(*[F.sum(F.col(s) * F.exp(F.col("xi") * F.datediff("date", anchor))).alias(s) for s in SUMS], F.max("date").alias("last_day"))
    )
    pairs = weekly.select("league", "xi", "home", "away").distinct()
    marks = pairs.join(folds, "league").select(
        "league", "xi", "home", "away", "week", *[F.lit(0.0).alias(s) for s in SUMS], F.lit(None).cast("date").alias("last_day"), F.lit(True).alias("mark")
    )
    axis = weekly.withColumn("mark", F.lit(False)).unionByName(marks)
    past = (
        W.partitionBy("league", "xi", "home", "away").orderBy(F.datediff("week", anchor))
        .rangeBetween(W.unboundedPreceding, -1)
    )
    run = axis.select("league", "xi", "home", "away", "week", "mark", *[F.sum(s).over(past).alias(s) for s in SUMS], F.max("last_day").over(past).alias("last_day"))
    return guard_sums(run.filter("mark AND n IS NOT NULL"), "last_day", "week", "n").select(
        "league", "week", "xi", "home", "away", *[(F.col(s) / grow).alias(s) for s in SUMS]
    )


def _low_score_terms(lam_h, lam_a, rho):
    """Per low score: (tau, d tau / d lam_h, d tau / d lam_a, d tau / d rho)."""
    zero, one = np.zeros_like(lam_h), np.ones_like(lam_h)
    return {
        "00": (1 - lam_h * lam_a * rho, -lam_a * rho, -lam_h * rho, -lam_h * lam_a),
        "01": (1 + lam_h * rho, rho * one, zero, lam_h),
        "10": (1 + lam_a * rho, zero, rho * one, lam_a),
        "11": ((1 - rho) * one, zero, zero, -one),
    }


class Fits(NamedTuple):
    """Fitted parameters of f problems over m teams; attacks of the present teams average one."""

    attack: np.ndarray
    defence: np.ndarray
    edge: np.ndarray
    rho: np.ndarray
    gradient: np.ndarray
    steps: int


def fit_batch(
    weight: np.ndarray, yh: np.ndarray, ya: np.ndarray, low: dict[str, np.ndarray], kappa: np.ndarray,
    tolerance: float = 1e-13, max_steps: int = 400,
) -> Fits:
    """Penalised weighted Poisson fits with the low-score term, many at once.

    Inputs have shape (f, m, m), indexed [fit, home, away]; ``kappa`` has shape (f,). Each step
    solves the Poisson information plus ridge for attacks, defences and home edge, then moves rho
    by a scalar step inside its bounds. A team without rows keeps zero strengths. A fit has converged
    when no gradient is above ``tolerance`` times its weight; one that hasn't fails the task.
    """
    f, m, _ = weight.shape
    att, dfc = np.zeros((f, m)), np.zeros((f, m))
    edge, rho, ridge = np.zeros(f), np.zeros(f), 2.0 * kappa[:, None]
    i = np.arange(m)
    gradient, steps = np.full(f, np.inf), 0
    enough = tolerance * np.maximum(1.0, weight.sum((1, 2)))
    for steps in range(1, max_steps + 1):
        lam_h = np.exp(att[:, :, None] + dfc[:, None, :] + edge[:, None, None])
        lam_a = np.exp(att[:, None, :] + dfc[:, :, None])
        wh, wa = weight * lam_h, weight * lam_a
        gh, ga = yh - wh, ya - wa
        g_rho, i_rho = np.zeros(f), np.zeros(f)
        for s, (tau, by_h, by_a, by_rho) in _low_score_terms(lam_h, lam_a, rho[:, None, None]).items():
            tau = np.maximum(tau, TAU_FLOOR)
            share = low[s] / tau
            gh, ga = gh + lam_h * share * by_h, ga + lam_a * share * by_a
            g_rho += (share * by_rho).sum((1, 2))
            i_rho += (share * by_rho**2 / tau).sum((1, 2))
        g = np.concatenate([
            gh.sum(2) + ga.sum(1) - ridge * att, gh.sum(1) + ga.sum(2) - ridge * dfc, gh.sum((1, 2))[:, None]
        ], axis=1)
        held = ((rho <= -RHO_BOUND) & (g_rho < 0)) | ((rho >= RHO_BOUND) & (g_rho > 0))
        gradient = np.maximum(np.abs(g).max(1), np.where(held, 0.0, np.abs(g_rho)))
        if (gradient < enough).all():
            break
        info = np.zeros((f, 2 * m + 1, 2 * m + 1))
        info[:, i, i] = wh.sum(2) + wa.sum(1) + ridge
        info[:, m + i, m + i] = wh.sum(1) + wa.sum(2) + ridge
        cross = wh + wa.transpose(0, 2, 1)
        info[:, :m, m : 2 * m], info[:, m : 2 * m, :m] = cross, cross.transpose(0, 2, 1)
        at_edge = np.concatenate([wh.sum(2), wh.sum(1)], axis=1)
        info[:, : 2 * m, 2 * m] = info[:, 2 * m, : 2 * m] = at_edge
        info[:, 2 * m, 2 * m] = wh.sum((1, 2)) + 1e-12
        move = np.linalg.solve(info, g[:, :, None])[:, :, 0]
        move *= np.minimum(1.0, 2.0 / np.maximum(np.abs(move).max(1), 1e-300))[:, None]
        att, dfc, edge = att + move[:, :m], dfc + move[:, m : 2 * m], edge + move[:, 2 * m]
        rho = np.clip(rho + np.divide(g_rho, i_rho, out=np.zeros(f), where=i_rho > 0), -RHO_BOUND, RHO_BOUND)
    else:
        raise ArithmeticError(f"{int((gradient >= enough).sum())} fits did not converge in {max_steps} steps")
    present = (weight.sum(2) + weight.sum(1)) > 0
    shift = np.log((np.exp(att) * present).sum(1) / np.maximum(present.sum(1), 1))[:, None]
    return Fits(att - shift, dfc + shift, edge, rho, gradient, steps)


def _fitter(settings: Sequence[Setting]):
    """Task function: every fold of one (league, year, xi) and every setting of that xi."""

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        league, _, xi = key
        chosen = [s for s in settings if s.xi == xi]
        weeks, at = np.unique(pdf["week"].to_numpy(), return_inverse=True)
        k = len(pdf)
        teams, ix = np.unique(np.concatenate([pdf["home"].to_numpy(), pdf["away"].to_numpy()]), return_inverse=True)
        m, h, a = len(teams), ix[:k], ix[k:]

        def dense(col: str, first: int, last: int) -> np.ndarray:
            out = np.zeros((last - first, m, m))
            rows = (at >= first) & (at < last)
            out[at[rows] - first, h[rows], a[rows]] = pdf[col].to_numpy(float)[rows]
            return out

        parts = []
        chunk = max(1, int(BATCH_CELLS / (m * m)))  # bounds the memory of a batch
        for first in range(0, len(weeks), chunk):
            last = min(first + chunk, len(weeks))
            sums = {c: dense(c, first, last) for c in SUMS}
            low = {s: sums[f"c{s}"] for s in LOW_SCORES}
            present = (sums["n"].sum(2) + sums["n"].sum(1)) > 0
            which, who = np.nonzero(present)
            for s in chosen:
                fits = fit_batch(
                    sums["n"], (1 - s.w) * sums["gh"] + s.w * sums["xh"], (1 - s.w) * sums["ga"] + s.w * sums["xa"],
                    low, np.full(last - first, s.kappa),
                )
                mean = lambda v: np.log((np.exp(v) * present).sum(1) / present.sum(1))[which]
                parts.append(pd.DataFrame({
                    "league": league, "week": weeks[first:last][which], "xi": xi, "w": s.w, "kappa": s.kappa,
                    "team": teams[who], "attack": fits.attack[which, who], "defence": fits.defence[which, who],
                    "home_edge": fits.edge[which], "rho": fits.rho[which], "attack_mean": mean(fits.attack),
                    "defence_mean": mean(fits.defence), "steps": fits.steps, "max_gradient": fits.gradient[which],
                    "n_train": sums["n"].sum((1, 2))[which], "n_teams": present.sum(1)[which],
                }))
        return pd.concat(parts, ignore_index=True)

    return fit


def fit_folds(sums: DataFrame, settings: Sequence[Setting]) -> DataFrame:
    """Strengths per (league, week, xi, w, kappa, team) from ``fold_sums``.

    A task receives a year of folds of one league and decay rate: at most 53 rows per ordered pair
    of teams, however many matches were played.
    """
    keys = ("league", "year", "xi")
    yearly = sums.withColumn("year", F.year("week"))
    return spread(yearly, *keys).groupBy(*keys).applyInPandas(_fitter(list(settings)), STRENGTH_SCHEMA)


def fit_all(played: DataFrame, folds: DataFrame, settings: Sequence[Setting]) -> DataFrame:
    return fit_folds(fold_sums(played, folds, sorted({s.xi for s in settings})), settings)
