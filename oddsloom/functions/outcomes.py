"""Outcome coding and per-forecast scores. Triples are arrays ordered home, draw, away."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import LOG_FLOOR


def outcome_index(home: Column, away: Column) -> Column:
    """0 home win, 1 draw, 2 away win; NULL while unplayed."""
    return F.when(home > away, 0).when(home == away, 1).when(home < away, 2)


def outcome_of_text(score: Column) -> Column:
    """Outcome index of a score written as ``h-a``."""
    parts = F.split(score, "-")
    return outcome_index(F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int"))


def triple(h: Column, d: Column, a: Column) -> Column:
    return F.array(h, d, a)


def hit(outcome: Column, k: int) -> Column:
    return F.when(outcome == k, 1.0).otherwise(0.0)


def brier(p: Column, outcome: Column) -> Column:
    """Sum of squared gaps between the triple and the observed outcome."""
    gaps = [F.pow(p[k] - hit(outcome, k), 2.0) for k in range(3)]
    return gaps[0] + gaps[1] + gaps[2]


def log_loss(p: Column, outcome: Column) -> Column:
    return -F.log(F.greatest(F.get(p, outcome), F.lit(LOG_FLOOR)))


def ranked_score(p: Column, outcome: Column) -> Column:
    """Ranked probability score over the ordered outcomes."""
    first = p[0] - hit(outcome, 0)
    second = p[0] + p[1] - hit(outcome, 0) - hit(outcome, 1)
    return (first * first + second * second) / 2.0


def argmax(values: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def correct(p: Column, outcome: Column) -> Column:
    return F.when(argmax(p) == outcome, 1.0).otherwise(0.0)


def binary_brier(p: Column, y: Column) -> Column:
    return F.pow(p - y, 2.0)


def total_variation(p: Column, q: Column) -> Column:
    return 0.5 * (F.abs(p[0] - q[0]) + F.abs(p[1] - q[1]) + F.abs(p[2] - q[2]))


UNIFORM = (1.0 / 3.0, 1.0 / 3.0, 1.0 / 3.0)


def uniform() -> Column:
    return F.array(*[F.lit(v) for v in UNIFORM])
