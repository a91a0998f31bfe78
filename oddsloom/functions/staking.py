"""Stake sizing and value flags (Column functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    FRESH_MAX_DAYS, KELLY_CAP, KELLY_FRACTION, RISK_LOW, RISK_MODERATE, STALE_MIN_DAYS,
    VALUE_CLEAR_PTS, VALUE_MODERATE_PTS,
)


def kelly(p: Column, odds: Column, fraction: float = KELLY_FRACTION, cap: float = KELLY_CAP) -> Column:
    """Fraction of the optimal growth stake, capped; no edge or no payoff gives 0."""
    payoff = odds - 1.0
    full = (p * payoff - (1.0 - p)) / payoff
    return F.when(payoff <= 0, 0.0).when(full <= 0, 0.0).otherwise(F.least(full * fraction, F.lit(cap)))


def risk_label(stake: Column) -> Column:
    return (
        F.when(stake <= 0, "none")
        .when(stake < RISK_LOW, "low")
        .when(stake < RISK_MODERATE, "moderate")
        .otherwise("high")
    )


def value_flag(model: Column, market: Column) -> Column:
    """Size of the model-market gap in points, either way."""
    gap = F.abs(model - market) * 100.0
    return F.when(gap >= VALUE_CLEAR_PTS, "clear").when(gap >= VALUE_MODERATE_PTS, "moderate").otherwise("none")


def freshness_bucket(age: Column) -> Column:
    return (
        F.when(age.isNull(), "unknown")
        .when(age <= FRESH_MAX_DAYS, "fresh")
        .when(age >= STALE_MIN_DAYS, "stale")
        .otherwise("between")
    )
