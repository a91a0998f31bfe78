"""From quoted odds to fair probabilities, and from there to blended ones.

All of it is plain Catalyst expressions over arrays ordered home, draw, away: the two methods
without a closed form take Newton steps inside ``aggregate`` over a constant sequence, so no row leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    BASE_BLEND, FRESH_MAX_DAYS, LEGACY_BLEND, MARGIN_MAX, MARGIN_MIN, OPEN_HORIZON, PROB_CLIP,
    STALE_FLOOR, STALE_MIN_DAYS,
)

NEWTON_STEPS = 16
POWER_STEPS = 12  # 10 reach machine precision for prices from 1.01 to 500


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def normalise(p: Column) -> Column:
    return F.transform(p, lambda v: v / _sum(p))


def implied(odds: Column) -> Column:
    return F.transform(odds, lambda o: 1.0 / o)


def book_sum(odds: Column) -> Column:
    return 1.0 / odds[0] + 1.0 / odds[1] + 1.0 / odds[2]


def quoted(odds: Column) -> Column:
    """True when all three prices exist and are not zero."""
    ok = [odds[k].isNotNull() & (odds[k] != 0) for k in range(3)]
    return ok[0] & ok[1] & ok[2]


LEAST_EXPONENT, MOST_EXPONENT = 1e-3, 20.0


def fair_proportional(odds: Column) -> Column:
    return normalise(implied(odds))


def power_exponent(odds: Column) -> Column:
    """k with sum((1/o)^k) = 1 in [0.001, 20], NULL when there is none; already fair books keep k = 1.

    At ln 3 / max(ln o) every term is at least a third, so that point lies left of the root.
    """
    logs = F.transform(odds, lambda o: F.log(o))

    def newton(l: Column) -> Column:
        # the excess is convex and falling in k: from the left the steps climb to the root without passing it
        def step(k: Column, _: Column) -> Column:
            powers = [F.exp(-k * l[i]) for i in range(3)]
            slope = powers[0] * l[0] + powers[1] * l[1] + powers[2] * l[2]
            return k + (powers[0] + powers[1] + powers[2] - 1.0) / slope

        start = F.try_divide(F.lit(math.log(3.0)), F.array_max(l))
        return F.aggregate(F.sequence(F.lit(1), F.lit(POWER_STEPS)), start, step)

    root = F.transform(F.array(logs), newton)
    fair_already = F.abs(book_sum(odds) - 1.0) < 1e-12
    # the root is bound by a lambda: an expression that is named three times would be solved three times
    return F.when(fair_already, 1.0).otherwise(
        F.transform(root, lambda k: F.when((k >= LEAST_EXPONENT) & (k <= MOST_EXPONENT), k))[0])


def fair_power(odds: Column) -> Column:
    k = power_exponent(odds)
    return F.transform(F.array(k), lambda e: F.transform(odds, lambda o: F.pow(o, -e)))[0]


def shin_share(odds: Column) -> Column:
    """Share z of informed money under which the insider-trading margin model sums to one.

    Sum p(z) = 1 is sum(sqrt(z^2 + 4 (1 - z) c)) = 2 + z with c = (1/o)^2 / booksum: convex in z, so
    Newton steps from 0 climb to the smaller root without passing it.
    """
    squares = F.transform(odds, lambda o: 1.0 / (o * o * book_sum(odds)))

    def newton(c: Column) -> Column:
        def step(z: Column, _: Column) -> Column:
            roots = F.transform(c, lambda v: F.sqrt(z * z + 4.0 * (1.0 - z) * v))
            both = F.struct(
                _sum(roots).alias("total"), _sum(F.zip_with(roots, c, lambda r, v: (z - 2.0 * v) / r)).alias("slope")
            )
            return F.transform(F.array(both), lambda b: z - (b["total"] - z - 2.0) / (b["slope"] - 1.0))[0]

        return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), step)

    return F.transform(F.array(squares), newton)[0]


def fair_shin(odds: Column) -> Column:
    """Insider-model margin removal; books without margin use the proportional rule."""
    booked = book_sum(odds)
    share = shin_share(odds)

    def at(z):
        raw = F.transform(
            odds,
            lambda o: (F.sqrt(z * z + 4.0 * (1.0 - z) / (o * o * booked)) - z) / (2.0 * (1.0 - z)),
        )
        return F.transform(F.array(raw), normalise)[0]

    solved = F.transform(F.array(share), at)[0]
    top = 1.0 - 1e-9
    saturated = sum(
        (F.sqrt(top * top + 4.0 * (1.0 - top) / (odds[i] * odds[i] * booked)) - top) / (2.0 * (1.0 - top))
        for i in range(3)
    ) > 1.0
    return (
        F.when(booked <= 1.0 + 1e-12, fair_proportional(odds))
        .when(saturated, fair_power(odds))
        .otherwise(solved)
    )


FAIR_METHODS = {"proportional": fair_proportional, "power": fair_power, "shin": fair_shin}


def fair(odds: Column, method: str) -> Column:
    if method not in FAIR_METHODS:
        raise ValueError(f"unknown margin method {method!r}; known: {sorted(FAIR_METHODS)}")
    return F.when(quoted(odds), FAIR_METHODS[method](odds))


def fair_two_way(yes: Column, no: Column) -> Column:
    """Fair probability of the first side of a two-way market; NULL when a side is not quoted."""
    ok = yes.isNotNull() & no.isNotNull() & (yes != 0) & (no != 0)
    return F.when(ok, (1.0 / yes) / (1.0 / yes + 1.0 / no))


def margin_ok(odds: Column) -> Column:
    m = book_sum(odds)
    return (m >= MARGIN_MIN - 1e-6) & (m <= MARGIN_MAX)


def freshness_weight(age: Column, margins_ok: Column, base: float = BASE_BLEND) -> Column:
    """Market weight by quote age: base while fresh, a floor once stale, linear in between."""
    floor = min(STALE_FLOOR, base)
    span = float(STALE_MIN_DAYS - FRESH_MAX_DAYS)
    sloped = floor + (base - floor) * (STALE_MIN_DAYS - age) / span
    w = (
        F.when(age.isNull() | (age <= FRESH_MAX_DAYS), F.lit(base))
        .when(age >= STALE_MIN_DAYS, F.lit(floor))
        .otherwise(sloped)
    )
    return F.when(margins_ok, w).otherwise(w * 0.5)


def legacy_weight(age: Column, base: float = LEGACY_BLEND) -> Column:
    span = float(STALE_MIN_DAYS - FRESH_MAX_DAYS)
    share = (
        F.when(age <= FRESH_MAX_DAYS, 1.0)
        .when(age >= STALE_MIN_DAYS, 0.0)
        .otherwise((STALE_MIN_DAYS - age) / span)
    )
    return base * share


def blend(market: Column, model: Column, weight: Column) -> Column:
    """Weighted mix of two triples, summing to one; without a market triple the model stands."""
    mixed = F.zip_with(market, model, lambda m, q: weight * m + (1.0 - weight) * q)
    return F.when(market.isNull(), model).otherwise(normalise(mixed))


def aged_fraction(age: Column, horizon: int = OPEN_HORIZON) -> Column:
    return F.least(age / float(horizon), F.lit(1.0))


def aged_fair(closing: Column, opening: Column, age: Column) -> Column:
    """Fair triple ``age`` days before kick-off, between the closing and the opening line."""
    f = aged_fraction(age)
    return normalise(F.zip_with(closing, opening, lambda c, o: (1.0 - f) * c + f * o))


def aged_taken_odds(
    closing_fair: Column, opening_fair: Column, closing_odds: Column, opening_odds: Column, age: Column
) -> tuple[Column, Column]:
    """(fair triple, quotable odds) at that age; the margin is interpolated on its own."""
    f = aged_fraction(age)
    taken = F.zip_with(closing_fair, opening_fair, lambda c, o: (1.0 - f) * c + f * o)
    margin = (1.0 - f) * book_sum(closing_odds) + f * book_sum(opening_odds)
    return taken, F.transform(taken, lambda p: 1.0 / (p * margin))


def temper(p: Column, t: Column) -> Column:
    """Temperature recalibration of a triple: q proportional to p^t."""
    return normalise(F.transform(p, lambda v: F.pow(v, t)))


def temper_binary(p: Column, t: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(PROB_CLIP)), F.lit(1.0 - PROB_CLIP))
    return F.pow(q, t) / (F.pow(q, t) + F.pow(1.0 - q, t))


def edges(model: Column, market: Column) -> Column:
    return F.zip_with(model, market, lambda m, q: m - q)
