"""Outcomes of the fixed derived markets (Column functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DERIVED_MARKETS, MARKET_GRID_SIZE
from . import grid as G

TOTAL_LINES = {"ou05": 0.5, "ou15": 1.5, "ou25": 2.5, "ou35": 3.5, "ou45": 4.5}


def handicap_outcome(home: Column, away: Column, line: Column) -> Column:
    margin = (home - away) + line
    return F.when(F.abs(margin) < 1e-9, "push").when(margin > 0, "home").when(margin < 0, "away")


def handicap_covered(home: Column, away: Column, line: Column) -> Column:
    """1 home covers, 0 away covers, NULL for a push or a missing line."""
    return F.when(handicap_outcome(home, away, line) == "home", 1).when(
        handicap_outcome(home, away, line) == "away", 0
    )


def market_hit(market: str, home: Column, away: Column) -> Column:
    """1 when the market's positive side came in, else 0."""
    if market in TOTAL_LINES:
        test = home + away > TOTAL_LINES[market]
    elif market == "btts":
        test = (home > 0) & (away > 0)
    elif market in ("home_ov15", "away_ov15"):
        test = (home if market == "home_ov15" else away) > 1.5
    else:
        raise ValueError(f"unknown derived market {market!r}")
    return F.when(test, 1).otherwise(0)


def market_prob(market: str, grids: dict[int, Column]) -> Column:
    """Probability of the positive side, read from the grid size that belongs to the market."""
    goals = MARKET_GRID_SIZE[market]
    g = grids[goals]
    if market in TOTAL_LINES:
        return G.over(g, goals, TOTAL_LINES[market])
    if market == "btts":
        return G.both_score(g, goals)
    if market in ("home_ov15", "away_ov15"):
        return G.team_over(g, goals, market.split("_")[0], 1.5)
    raise ValueError(f"unknown derived market {market!r}")


def all_market_hits(home: Column, away: Column) -> Column:
    """Array of (market, y) structs, one per fixed market."""
    return F.array(
        *[F.struct(F.lit(m).alias("market"), market_hit(m, home, away).alias("y")) for m in DERIVED_MARKETS]
    )
