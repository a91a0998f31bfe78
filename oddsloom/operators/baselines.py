"""Walk-forward frequency baselines: shares of earlier results only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import DERIVED_MARKETS, GRID_GOALS
from ..functions.calendar import monday
from ..functions.markets import market_hit
from ..functions.outcomes import outcome_index
from ..session import keep


def earlier_weeks() -> WindowSpec:
    """Everything before the current week of the league; rows are one per league and week."""
    return W.partitionBy("league").orderBy("week").rowsBetween(W.unboundedPreceding, -1)



def with_week(df: DataFrame) -> DataFrame:
    return df.withColumn("week", monday(F.col("date")))


def _weekly(played: DataFrame, sums: dict) -> DataFrame:
    """One row per league and week: rows collapse map-side before anything is ordered."""
    return with_week(played).groupBy("league", "week").agg(*[e.alias(n) for n, e in sums.items()])


def outcome_frequencies(played: DataFrame) -> DataFrame:
    """(league, week, freq triple): shares of H/D/A among rows before that week's Monday."""
    o = outcome_index(F.col("fthg"), F.col("ftag"))
    weekly = _weekly(played, {f"n{k}": F.count_if(o == k) for k in range(3)})
    run = weekly.select(
        "league", "week", *[F.coalesce(F.sum(f"n{k}").over(earlier_weeks()), F.lit(0)).alias(f"c{k}") for k in range(3)]
    )
    total = F.col("c0") + F.col("c1") + F.col("c2")
    share = lambda c: F.when(total > 0, F.col(c) / total).otherwise(1.0 / 3.0)
    return run.select("league", "week", F.array(share("c0"), share("c1"), share("c2")).alias("freq"))


def with_frequency(played: DataFrame, seasons: Sequence) -> DataFrame:
    """Target-season rows with the week's frequency triple as ``freq``."""
    target = with_week(played.filter(F.col("season").isin(list(seasons))))
    return target.join(keep(outcome_frequencies(played)), ["league", "week"])


def market_frequencies(played: DataFrame) -> DataFrame:
    """(league, week, market, freq): earlier share of each derived market's positive side."""
    sums = {m: F.sum(market_hit(m, F.col("fthg"), F.col("ftag"))) for m in DERIVED_MARKETS}
    weekly = _weekly(played, {"n": F.count("*"), **sums})
    prior_n = F.coalesce(F.sum("n").over(earlier_weeks()), F.lit(0))
    run = weekly.select(
        "league", "week", prior_n.alias("prior_n"),
        *[F.coalesce(F.sum(m).over(earlier_weeks()), F.lit(0)).alias(m) for m in DERIVED_MARKETS],
    )
    packed = F.array(
        *[
            F.struct(
                F.lit(m).alias("market"),
                F.when(F.col("prior_n") > 0, F.col(m) / F.col("prior_n")).otherwise(0.5).alias("freq"),
            )
            for m in DERIVED_MARKETS
        ]
    )
    return run.select("league", "week", F.inline(packed))


def score_frequencies(played: DataFrame, goals: int = GRID_GOALS) -> DataFrame:
    """(league, week, h, a, p): earlier exact-score shares, goals clipped, every cell starting at 1."""
    clipped = with_week(played).select(
        "league", "week",
        F.least(F.col("fthg"), F.lit(goals)).cast("int").alias("h"),
        F.least(F.col("ftag"), F.lit(goals)).cast("int").alias("a"),
    )
    counts = clipped.groupBy("league", "week", "h", "a").agg(F.count("*").alias("n"))
    weeks = clipped.select("league", "week").distinct()
    axis = F.sequence(F.lit(0), F.lit(goals))
    dense = weeks.withColumn("h", F.explode(axis)).withColumn("a", F.explode(axis))
    cell = W.partitionBy("league", "h", "a").orderBy("week").rowsBetween(W.unboundedPreceding, -1)
    run = dense.join(counts, ["league", "week", "h", "a"], "left").withColumn(
        "c", 1.0 + F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(cell), F.lit(0))
    )
    grid = W.partitionBy("league", "week")
    return run.select("league", "week", "h", "a", (F.col("c") / F.sum("c").over(grid)).alias("p"))
