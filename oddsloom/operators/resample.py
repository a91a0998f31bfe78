"""Seeded resampling: bootstrap intervals, permutations and two-sample statistics.

The bootstrap weighs rows instead of drawing them: in replicate b a row counts w times, w being the
Poisson(1) quantile of an integer hash of (seed, b, id). A weight depends on its own row alone, so
each task turns its rows into ``resamples`` weighted sums in one vectorised pass; rows are dealt once to
even parts, and but for that only those sums are shuffled: no row is copied, ranked or joined, whatever the number of replicates. The same
seed gives the same interval on any cluster layout, and a lost task recomputes exactly its own
weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import CONFIDENCE, PERMUTATIONS, RESAMPLES, SEED
from ..functions.mixing import MASK, RANGE, mix, mix_array, mix_into
from ..session import spread
from .windows import rank_within

SLICE_BITS = 20  # 32-bit hashes fall into 4096 equal slices
BLOCK_ROWS = 4096  # rows that a permutation moves among each other
CELLS = 1 << 16  # weights worked out at a time: their arrays stay in a core's cache
BLOCK_IDS = 64  # rows among them
COMMON = 6  # weights up to here are counted for all cells, the few larger ones looked up


def poisson_steps() -> list[int]:
    """Hashes from which a weight is at least 1, 2, ...: the distribution function times 2^32."""
    steps, total, term = [], 0.0, math.exp(-1.0)
    for k in range(1, 20):
        total += term
        term /= k
        if (step := int(RANGE * total)) >= RANGE - 1:
            break
        steps.append(step)
    return steps


STEPS = poisson_steps()


def add_weighted(total: np.ndarray, seed: int, ids: np.ndarray, values: np.ndarray) -> None:
    """Add every replicate's Poisson-weighted sums of ``values`` (columns, rows) to ``total`` (columns, replicates)."""
    states, low = mix_array(seed, np.arange(total.shape[1])), (ids & MASK).astype(np.uint32)
    steps, eight = np.array(STEPS, np.uint32), np.arange(8)
    width = CELLS // BLOCK_IDS
    for b in range(0, len(states), width):
        state = states[b : b + width]
        shape = (min(BLOCK_IDS, len(low)), len(state))
        hashes, shifted, wide = np.empty(shape, np.uint32), np.empty(shape, np.uint32), np.empty(shape)
        room = -(-hashes.size // 8) * 8  # whole words of eight cells
        counts, above = np.empty(room, np.uint8), np.zeros(room, bool)
        for at in range(0, len(low), BLOCK_IDS):
            part = low[at : at + BLOCK_IDS, None]
            h = hashes[: len(part)]
            mix_into(state, part, h, shifted[: len(part)])
            cells = h.reshape(-1)
            above[len(cells) :] = False
            np.greater_equal(cells, steps[0], out=above[: len(cells)])
            counts[:] = above
            for step in steps[1:COMMON]:
                np.greater_equal(cells, step, out=above[: len(cells)])
                np.add(counts, above.view(np.uint8), out=counts)
            np.greater_equal(cells, steps[COMMON], out=above[: len(cells)])
            rare = (np.flatnonzero(above.view(np.uint64) != 0)[:, None] * 8 + eight).ravel()
            rare = rare[rare < len(cells)]
            counts[rare] = np.searchsorted(steps, cells[rare], side="right")
            w = wide[: len(part)]
            w[:] = counts[: len(cells)].reshape(h.shape)
            total[:, b : b + width] += values[:, at : at + BLOCK_IDS] @ w


def replicate_means(
    df: DataFrame, cols: Sequence[str], id_col: str, keys: Sequence[str] = (), seed: int = SEED,
    resamples: int = RESAMPLES,
) -> DataFrame:
    """keys + b + the weighted mean of every column over replicate b; all columns share the weights."""
    rows = df.select(*keys, F.col(id_col).cast("long").alias("_id"), *[F.col(c).cast("double").alias(c) for c in cols])
    n_keys = len(keys)
    key_fields = [rows.schema[k] for k in keys]
    names = [*keys, "_sums"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        kinds: list = []
        for batch in batches:
            kinds = [f.type for f in batch.schema][:n_keys]
            ids = batch.column(n_keys).to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.stack([np.ones(len(ids)), *(batch.column(n_keys + 1 + i).to_numpy(zero_copy_only=False) for i in range(len(cols)))])
            for key, place in _positions(batch, n_keys).items():
                if key not in total:
                    total[key] = np.zeros((1 + len(cols), resamples))
                add_weighted(total[key], seed, ids[place], values[:, place])
        for key, found in total.items():
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([k], t) for k, t in zip(key, kinds)), pa.array([found.T.tolist()], pa.list_(pa.list_(pa.float64())))], names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields), "_sums array<array<double>>"])
    parts = spread(rows, "_id").mapInArrow(sums, schema).select(*keys, F.posexplode("_sums").alias("b", "_s"))
    added = parts.groupBy(*keys, "b").agg(*[F.sum(F.col("_s")[i]).alias(f"_{i}") for i in range(1 + len(cols))])
    return added.select(*keys, "b", *[F.try_divide(F.col(f"_{i + 1}"), F.col("_0")).alias(c) for i, c in enumerate(cols)])


def _positions(batch: pa.RecordBatch, n_keys: int) -> dict[tuple, np.ndarray]:
    """Row numbers of each key of a batch."""
    if not n_keys:
        return {(): np.arange(batch.num_rows)}
    found: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(n_keys)))):
        found.setdefault(key, []).append(i)
    return {key: np.array(rows) for key, rows in found.items()}


def _interval(values: Column, n: Column, confidence: float) -> list[Column]:
    tail = (1.0 - confidence) / 2.0
    q = F.percentile(values, F.array(F.lit(tail), F.lit(1.0 - tail)))
    return [F.when(n >= 2, q[0]).alias("lo"), F.when(n >= 2, q[1]).alias("hi")]


def excludes_zero(lo: Column, hi: Column) -> Column:
    """NULL without an interval."""
    return F.when(lo.isNotNull() & hi.isNotNull(), (lo > 0) | (hi < 0))


def _finish(points: DataFrame, draws: DataFrame, keys: Sequence[str], confidence: float) -> DataFrame:
    """Join points (keys, n, point) with draws (keys, b, value) into intervals and a verdict."""
    if keys:
        joined = points.join(draws, list(keys), "left")
        bounds = joined.groupBy(*keys, "n", "point").agg(*_interval(F.col("value"), F.first("n"), confidence))
    else:
        tail = (1.0 - confidence) / 2.0
        q = draws.agg(F.percentile("value", F.array(F.lit(tail), F.lit(1.0 - tail))).alias("q"))
        bounds = points.join(F.broadcast(q)).select(  # both sides are single rows
            "n", "point", F.when(F.col("n") >= 2, F.col("q")[0]).alias("lo"), F.when(F.col("n") >= 2, F.col("q")[1]).alias("hi")
        )
    return bounds.withColumn("excludes_zero", excludes_zero(F.col("lo"), F.col("hi")))


def mean_interval(
    df: DataFrame, col: str, id_col: str, keys: Sequence[str] = (), seed: int = SEED, resamples: int = RESAMPLES,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """Percentile interval of a mean per group: n, point, lo, hi, excludes_zero."""
    rows = df.filter(F.col(col).isNotNull()).select(id_col, *keys, col)
    points = _agg(rows, keys, F.count("*").alias("n"), F.avg(col).alias("point"))
    draws = replicate_means(rows, [col], id_col, keys, seed, resamples).withColumnRenamed(col, "value")
    return _finish(points, draws, keys, confidence)


def _gap_pct(score: Column, reference: Column) -> Column:
    return F.try_divide(score - reference, reference) * 100.0


def _agg(df: DataFrame, keys: Sequence[str], *exprs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*exprs) if keys else df.agg(*exprs)


def paired_gap_interval(
    df: DataFrame, score: str, reference: str, id_col: str, keys: Sequence[str] = (), seed: int = SEED,
    resamples: int = RESAMPLES, confidence: float = CONFIDENCE,
) -> DataFrame:
    """Interval of the relative gap (%) of two series scored on the same rows, drawn together.

    Both columns sit on one row, so they cannot come apart; a row with only one of them fails.
    """
    uneven = F.col(score).isNull() != F.col(reference).isNull()
    checked = df.withColumn(score, F.when(uneven, F.raise_error(F.lit("series are not paired")).cast("double")).otherwise(F.col(score)))
    rows = checked.filter(F.col(score).isNotNull()).select(id_col, *keys, score, reference)
    points = _agg(rows, keys, F.count("*").alias("n"), _gap_pct(F.avg(score), F.avg(reference)).alias("point"))
    draws = replicate_means(rows, [score, reference], id_col, keys, seed, resamples)
    value = draws.select(*keys, "b", _gap_pct(F.col(score), F.col(reference)).alias("value"))
    return _finish(points, value, keys, confidence)


def _two_groups(
    a: DataFrame, b: DataFrame, cols: Sequence[str], id_col: str, seed: int, resamples: int, combine
) -> DataFrame:
    da = replicate_means(a, cols, id_col, (), seed, resamples).withColumnsRenamed({c: f"{c}_a" for c in cols})
    db = replicate_means(b, cols, id_col, (), seed + 1, resamples).withColumnsRenamed({c: f"{c}_b" for c in cols})
    return da.join(db, "b").select("b", combine("_a", "_b").alias("value"))


def difference_interval(
    a: DataFrame, b: DataFrame, col: str, id_col: str, seed: int = SEED, resamples: int = RESAMPLES,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """mean(a) - mean(b) of two disjoint groups, drawn independently; ``n`` is the smaller group."""
    a, b = (g.filter(F.col(col).isNotNull()).select(id_col, col) for g in (a, b))
    pa = a.agg(F.count("*").alias("n_a"), F.avg(col).alias("m_a"))
    pb = b.agg(F.count("*").alias("n_b"), F.avg(col).alias("m_b"))
    points = pa.join(pb).select(F.least("n_a", "n_b").alias("n"), (F.col("m_a") - F.col("m_b")).alias("point"))
    draws = _two_groups(a, b, [col], id_col, seed, resamples, lambda x, y: F.col(col + x) - F.col(col + y))
    return _finish(points, draws, (), confidence)


def gap_difference_interval(
    a: DataFrame, b: DataFrame, score: str, reference: str, id_col: str, seed: int = SEED, resamples: int = RESAMPLES,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """Difference in points between the relative gaps of two disjoint groups, paired inside each."""
    def one(df: DataFrame, tag: str) -> DataFrame:
        return df.agg(F.count("*").alias(f"n{tag}"), _gap_pct(F.avg(score), F.avg(reference)).alias(f"g{tag}"))

    a, b = (g.select(id_col, score, reference) for g in (a, b))
    both = one(a, "_a").join(one(b, "_b"))
    usable = F.least("n_a", "n_b") >= 2
    points = both.select(
        F.least("n_a", "n_b").alias("n"), F.when(usable, F.col("g_a") - F.col("g_b")).alias("point")
    )
    gap = lambda t: _gap_pct(F.col(score + t), F.col(reference + t))
    draws = _two_groups(a, b, [score, reference], id_col, seed, resamples, lambda x, y: gap(x) - gap(y))
    return _finish(points, draws, (), confidence)


def permute_within(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str], order: Sequence[str], bucket: Column, id_col: str, seed: int
) -> DataFrame:
    """``cols`` moved together between the rows of each key by one seeded permutation."""
    fixed = rank_within(df.drop(*cols), keys, order, bucket, "_to")
    hashed = df.select(*keys, id_col, *cols).withColumn("_h", mix(seed, F.col(id_col)))
    moved = rank_within(hashed, keys, ["_h", id_col], F.shiftright("_h", SLICE_BITS), "_to").drop("_h", id_col)
    return fixed.join(moved, [*keys, "_to"]).drop("_to").select(*df.columns)


def permutation_lift(
    bets: DataFrame, weight: float, threshold: float, id_col: str, seed: int = SEED, permutations: int = PERMUTATIONS
) -> DataFrame:
    """Does the movement carry the selection? One row: real lift, p-value, mean and p95 of lifts.

    ``bets``: id, edge, movement, roi. Movements are permuted across bets; edges and results stay.
    Bets are dealt by a hash to blocks of about ``BLOCK_ROWS``, and a permutation moves movements
    within each block: the bet of the block's r-th id gets the movement of the bet with the r-th
    hash. A task holds a block, and what leaves it is two sums for each permutation. Permutations
    that select nothing are dropped; a test whose selection is empty has no p-value.
    """
    rows = bets.select(F.col(id_col).cast("long").alias("id"), "edge", "movement", "roi")
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))

    def permuted(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id")
        ids, edge, movement, roi = (block[c].to_numpy() for c in ("id", "edge", "movement", "roi"))
        n, total = np.zeros(permutations), np.zeros(permutations)
        for b in range(permutations):
            order = np.lexsort((ids, mix_array(mix_array(seed, np.array([b])), ids)))
            chosen = edge + weight * movement[order] > threshold
            n[b], total[b] = chosen.sum(), roi[chosen].sum()
        return pd.DataFrame({"b": np.arange(permutations), "n": n, "roi": total})

    drawn = rows.groupBy((mix(0, F.col("id")) % blocks).alias("block")).applyInPandas(permuted, "b int, n double, roi double")
    selected = F.col("edge") + weight * F.col("movement") > threshold
    overall = rows.agg(
        F.count("*").alias("n"), F.avg("roi").alias("baseline_roi"),
        F.avg(F.when(selected, F.col("roi"))).alias("selected_roi"), F.count_if(selected).alias("n_selected"),
    )
    lifts = drawn.groupBy("b").agg(F.try_divide(F.sum("roi"), F.sum("n")).alias("roi")).filter("roi is not null")
    # a single row beside at most ``permutations`` rows
    both = F.broadcast(overall).join(lifts, F.col("n").isNotNull(), "left").withColumn("lift", F.col("roi") - F.col("baseline_roi"))
    real = F.col("selected_roi") - F.col("baseline_roi")
    exceeds = F.when(real.isNotNull() & F.col("lift").isNotNull(), (F.col("lift") >= real).cast("double"))
    return both.groupBy("n", "n_selected", "baseline_roi", "selected_roi").agg(
        F.count("lift").alias("n_effective"), F.avg(exceeds).alias("p_value"),
        F.avg("lift").alias("mean_lift"), F.percentile("lift", F.lit(0.95)).alias("p95_lift"),
    ).withColumn("real_lift", real)


def welch(df: DataFrame, value: str, short: Column, keys: Sequence[str]) -> DataFrame:
    """Short group against the rest per key: means, difference, z and whether |z| > 1.96."""
    x = F.col(value)
    one = lambda f, test: f(F.when(test, x))
    out = df.groupBy(*keys).agg(
        F.count_if(short).alias("n_short"), F.count_if(~short).alias("n_rest"),
        one(F.avg, short).alias("mean_short"), one(F.avg, ~short).alias("mean_rest"),
        one(F.var_samp, short).alias("_vs"), one(F.var_samp, ~short).alias("_vr"),
    )
    se = F.sqrt(F.try_divide(F.col("_vs"), F.col("n_short")) + F.try_divide(F.col("_vr"), F.col("n_rest")))
    enough = (F.col("n_short") > 5) & (F.col("n_rest") > 5)
    diff = F.col("mean_short") - F.col("mean_rest")
    z = F.when(enough, F.when(se > 0, diff / se).otherwise(0.0))
    return out.withColumn("difference", F.when(enough, diff)).withColumn("z", z).withColumn(
        "significant", F.abs("z") > 1.96
    ).drop("_vs", "_vr")


def upper_median(df: DataFrame, col: str, id_col: str, bucket: Column) -> DataFrame:
    """One row ``median``: the element at position n // 2 of the sorted values.

    ``bucket`` does not decrease with the value. Running bucket counts find the one bucket that
    holds the position; the values of that bucket alone are counted and ordered.
    """
    tagged = df.select(F.col(col).alias("_v"), bucket.alias("_slice"))
    sizes = tagged.groupBy("_slice").agg(F.count("*").alias("_n"))
    along = W.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(W.unboundedPreceding, 0)  # a row for each bucket
    upto = sizes.select("_slice", "_n", F.sum("_n").over(along).alias("_upto"), F.sum("_n").over(W.partitionBy(F.lit(0))).alias("_all"))
    target = F.floor(F.col("_all") / 2)
    home = upto.filter((F.col("_upto") - F.col("_n") <= target) & (target < F.col("_upto"))).select(
        "_slice", (target - (F.col("_upto") - F.col("_n"))).alias("_place"))
    values = tagged.join(F.broadcast(home), "_slice").groupBy("_v", "_place").agg(F.count("*").alias("_n"))
    inside = W.partitionBy(F.lit(0)).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)  # different values of one bucket
    placed = values.withColumn("_upto", F.sum("_n").over(inside))
    return placed.filter((F.col("_upto") - F.col("_n") <= F.col("_place")) & (F.col("_place") < F.col("_upto"))).select(F.col("_v").alias("median"))


def median_split(df: DataFrame, col: str, id_col: str, bucket: Column) -> DataFrame:
    """Adds ``half``: low (<= median) or high."""
    mid = upper_median(df, col, id_col, bucket)
    return df.join(F.broadcast(mid)).withColumn("half", F.when(F.col(col) <= F.col("median"), "low").otherwise("high"))
