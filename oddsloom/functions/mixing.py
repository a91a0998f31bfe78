"""Deterministic draws: the same integers in Spark and in SQL, without a random generator.

A 32-bit finaliser (shift-xor and odd multipliers below 2^31) runs in plain 64-bit arithmetic, so
it stays inside generated code and never overflows under ANSI rules.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 1 << 32
MASK = RANGE - 1
FACTOR_1 = 569420461
FACTOR_2 = 1935289751


def _shift_xor(x: Column, bits: int) -> Column:
    return x.bitwiseXOR(F.shiftright(x, bits))


def _finalise(x: Column) -> Column:
    x = (_shift_xor(x, 16) * FACTOR_1).bitwiseAND(F.lit(MASK))
    x = (_shift_xor(x, 15) * FACTOR_2).bitwiseAND(F.lit(MASK))
    return _shift_xor(x, 15)


def _finalise_int(x: int) -> int:
    x = ((x ^ (x >> 16)) * FACTOR_1) & MASK
    x = ((x ^ (x >> 15)) * FACTOR_2) & MASK
    return x ^ (x >> 15)


def mix(seed: int, *keys: Column) -> Column:
    """Integer in [0, 2^32) that depends on the seed and on every key."""
    x: Column | None = None
    for key in keys:
        low = key.cast("long").bitwiseAND(F.lit(MASK))
        before = F.lit(_finalise_int(seed & MASK)) if x is None else x
        x = _finalise((before + low).bitwiseAND(F.lit(MASK)))
    return x


def absorb(state: Column, key: Column) -> Column:
    """One round: fold ``key`` into a state column. ``mix(seed, a, b)`` is two rounds; keeping the
    first as a column of its own keeps the expression small."""
    low = key.cast("long").bitwiseAND(F.lit(MASK))
    return _finalise((state + low).bitwiseAND(F.lit(MASK)))


def mix_array(state: int | np.ndarray, key: np.ndarray) -> np.ndarray:
    """One round in numpy: a seed, or the values of the round before, with integer keys."""
    before = np.uint32(_finalise_int(state & MASK)) if isinstance(state, int) else state
    x = before + (key & MASK).astype(np.uint32)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(FACTOR_1)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(FACTOR_2)
    return x ^ (x >> np.uint32(15))


def mix_into(state: np.ndarray, low: np.ndarray, out: np.ndarray, shifted: np.ndarray) -> None:
    """``mix_array`` of 32-bit states and keys, in the caller's arrays."""
    np.add(state, low, out=out)
    for bits, factor in ((16, FACTOR_1), (15, FACTOR_2), (15, None)):
        np.right_shift(out, np.uint32(bits), out=shifted)
        np.bitwise_xor(out, shifted, out=out)
        if factor is not None:
            np.multiply(out, np.uint32(factor), out=out)


def finalise_sql(x: str) -> str:
    a = f"((xor({x}, ({x}) >> 16) * {FACTOR_1}) & {MASK})"
    b = f"((xor({a}, {a} >> 15) * {FACTOR_2}) & {MASK})"
    return f"xor({b}, {b} >> 15)"


def mix_sql(seed: int, *keys: str) -> str:
    """SQL text of the same value."""
    x = str(_finalise_int(seed & MASK))
    for key in keys:
        x = finalise_sql(f"(({x} + (CAST({key} AS BIGINT) & {MASK})) & {MASK})")
    return x
