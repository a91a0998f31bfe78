"""Score grids as arrays: (goals + 1)^2 cells in row-major order (home goals first).

A grid is one array column per match, so every market read from it is a narrow projection: no
explode and no shuffle, whatever the number of matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import GRID_GOALS


def poisson_row(rate: Column, goals: int) -> Column:
    """Poisson probabilities of 0..goals."""
    terms = F.array(*[F.lit(math.lgamma(k + 1.0)) for k in range(goals + 1)])
    return F.transform(terms, lambda lf, k: F.exp(k * F.log(rate) - rate - lf))


def score_grid(lam_h: Column, lam_a: Column, rho: Column, goals: int = GRID_GOALS) -> Column:
    """Joint score probabilities with the low-score dependence term, floored at 0, summing to 1."""
    low = {
        (0, 0): 1.0 - lam_h * lam_a * rho,
        (0, 1): 1.0 + lam_h * rho,
        (1, 0): 1.0 + lam_a * rho,
        (1, 1): 1.0 - rho,
    }

    def cells(pair: Column) -> Column:
        ph, pa = pair["h"], pair["a"]
        independent = F.flatten(F.transform(ph, lambda x: F.transform(pa, lambda y: x * y)))

        def adjust(p: Column, i: Column) -> Column:
            out = F.when(F.lit(False), p)
            for (h, a), factor in low.items():
                out = out.when(i == h * (goals + 1) + a, F.greatest(p * factor, F.lit(0.0)))
            return out.otherwise(p)

        return F.transform(independent, adjust)

    def scaled(g: Column) -> Column:
        return F.transform(
            F.array(F.aggregate(g, F.lit(0.0), lambda s, p: s + p)),
            lambda total: F.transform(g, lambda p: p / total),
        )[0]

    # one-element transforms bind an intermediate once instead of repeating its expression
    rows = F.array(F.struct(poisson_row(lam_h, goals).alias("h"), poisson_row(lam_a, goals).alias("a")))
    return F.transform(F.transform(rows, cells), scaled)[0]


def region(goals: int, keep: Callable[[int, int], bool]) -> list[int]:
    """Positions of the cells (h, a) for which ``keep`` holds."""
    n = goals + 1
    return [h * n + a for h in range(n) for a in range(n) if keep(h, a)]


def region_sum(grid: Column, goals: int, keep: Callable[[int, int], bool]) -> Column:
    """Probability of a fixed region of the grid, reading only the smaller of region and complement."""
    inside = region(goals, keep)
    outside = region(goals, lambda h, a: not keep(h, a))

    def total(positions: list[int]) -> Column:
        if not positions:
            return F.lit(0.0)
        return F.aggregate(
            F.array(*[F.lit(i) for i in positions]), F.lit(0.0), lambda s, i: s + F.get(grid, i)
        )

    return total(inside) if len(inside) <= len(outside) else 1.0 - total(outside)


def outcome_probs(grid: Column, goals: int = GRID_GOALS) -> Column:
    return F.array(
        region_sum(grid, goals, lambda h, a: h > a),
        region_sum(grid, goals, lambda h, a: h == a),
        region_sum(grid, goals, lambda h, a: h < a),
    )


def over(grid: Column, goals: int, line: float) -> Column:
    return region_sum(grid, goals, lambda h, a: h + a > line)


def both_score(grid: Column, goals: int) -> Column:
    return region_sum(grid, goals, lambda h, a: h > 0 and a > 0)


def team_over(grid: Column, goals: int, side: str, line: float) -> Column:
    if side not in ("home", "away"):
        raise ValueError(f"unknown side {side!r}")
    return region_sum(grid, goals, lambda h, a: (h if side == "home" else a) > line)


def handicap_probs(grid: Column, goals: int, line: Column) -> Column:
    """Struct of P(home covers), P(away covers), P(push) for a handicap added to the home score."""
    n = goals + 1
    gaps = F.array(*[F.lit(float(i // n - i % n)) for i in range(n * n)])

    def part(test: Callable[[Column], Column]) -> Column:
        kept = F.zip_with(grid, gaps, lambda p, g: F.when(test(g + line), p).otherwise(0.0))
        return F.aggregate(kept, F.lit(0.0), lambda s, v: s + v)

    return F.struct(
        part(lambda x: x >= 1e-9).alias("home"),
        part(lambda x: x <= -1e-9).alias("away"),
        part(lambda x: F.abs(x) < 1e-9).alias("push"),
    )


def handicap_conditional(grid: Column, goals: int, line: Column) -> Column:
    """P(home covers | no push), one half when nothing is left."""
    return F.transform(
        F.array(handicap_probs(grid, goals, line)),
        lambda s: F.when(s["home"] + s["away"] > 0, s["home"] / (s["home"] + s["away"])).otherwise(0.5),
    )[0]


def ranked_scores(grid: Column, goals: int) -> Column:
    """Cells as structs (p, h, a), most likely first; equal cells with the larger score first."""
    n = goals + 1
    cells = F.transform(
        grid,
        lambda p, i: F.struct(p.alias("p"), F.floor(i / n).cast("int").alias("h"), (i % n).alias("a")),
    )
    return F.sort_array(cells, asc=False)


def top_scores(grid: Column, goals: int, k: int) -> Column:
    return F.slice(ranked_scores(grid, goals), 1, k)


def in_top(grid: Column, goals: int, h: Column, a: Column, k: int) -> Column:
    """Whether the score is among the k most likely; a score outside the grid is a miss."""
    return F.exists(top_scores(grid, goals, k), lambda s: (s["h"] == h) & (s["a"] == a))


def best_score_by_outcome(grid: Column, goals: int, outcome: str) -> Column:
    """Struct (p, h, a, share): likeliest score within an outcome, first in row-major order on ties."""
    tests = {"home": lambda h, a: h > a, "draw": lambda h, a: h == a, "away": lambda h, a: h < a}
    n = goals + 1
    positions = region(goals, tests[outcome])
    cells = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(i // n).alias("h"), F.lit(i % n).alias("a")) for i in positions]
    )
    ranked = F.transform(
        cells, lambda c: F.struct(F.get(grid, c["i"]).alias("p"), (-c["i"]).alias("o"), c["h"], c["a"])
    )
    best = F.array_max(ranked)
    mass = region_sum(grid, goals, tests[outcome])
    return F.transform(
        F.array(best),
        lambda b: F.struct(b["p"].alias("p"), b["h"].alias("h"), b["a"].alias("a"), (b["p"] / mass).alias("share")),
    )[0]
