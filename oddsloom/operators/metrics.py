"""Forecast scoring as aggregations (scores, calibration, breakdowns, verdicts)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import (
    CALIBRATION_MIN_N, CALIBRATION_TOLERANCE, CALIBRATION_WIDTH, CLEAR_MARGIN, LONGSHOT_BELOW,
)
from ..functions.outcomes import brier, correct, log_loss, ranked_score
from ..session import keep


def long_methods(df: DataFrame, methods: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """One row per forecast and method: ``keep`` + (method, probs). Missing triples are dropped."""
    packed = F.array(*[F.struct(F.lit(m).alias("method"), p.alias("probs")) for m, p in methods.items()])
    return (
        df.select(*keep, F.explode(packed).alias("_m"))
        .select(*keep, F.col("_m.method").alias("method"), F.col("_m.probs").alias("probs"))
        .filter(F.col("probs").isNotNull())
    )


def score_columns(p: Column, outcome: Column) -> list[Column]:
    return [
        F.count("*").alias("n"),
        F.avg(brier(p, outcome)).alias("brier"),
        F.avg(log_loss(p, outcome)).alias("log_loss"),
        F.avg(correct(p, outcome)).alias("accuracy"),
    ]


def method_scores(long: DataFrame) -> DataFrame:
    """n, Brier, log-loss and accuracy per method."""
    return long.groupBy("method").agg(*score_columns(F.col("probs"), F.col("outcome")))


def method_rollup(long: DataFrame) -> DataFrame:
    """The same by league and season, with sub-totals in one pass; totals carry 'all'."""
    rolled = long.withColumn("season", F.col("season").cast("string"))
    return (
        rolled.rollup("method", "league", "season")
        .agg(*score_columns(F.col("probs"), F.col("outcome")), F.grouping_id().alias("_g"))
        .filter("_g < 7")
        .withColumn("league", F.coalesce("league", F.lit("all")))
        .withColumn("season", F.coalesce("season", F.lit("all")))
        .drop("_g")
    )


def league_season_gaps(long: DataFrame, model: str = "model", reference: str = "market") -> DataFrame:
    """Brier per method side by side for each league and season, and the relative gap in %."""
    methods = list(dict.fromkeys([model, reference, "freq", "uniform"]))
    wide = (
        long.groupBy("league", "season")
        .pivot("method", methods)
        .agg(F.avg(brier(F.col("probs"), F.col("outcome"))))
    )
    counts = long.filter(F.col("method") == model).groupBy("league", "season").agg(F.count("*").alias("n"))
    return counts.join(wide, ["league", "season"]).withColumn(
        "gap_pct", F.try_divide((F.col(model) - F.col(reference)) * 100.0, F.col(reference))
    )


def calibration_pairs(df: DataFrame, probs: Column, outcome: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Three (p, hit) rows per forecast."""
    return df.select(*keep, outcome.alias("_o"), F.posexplode(probs).alias("_k", "p")).select(
        *keep, "p", F.when(F.col("_k") == F.col("_o"), 1.0).otherwise(0.0).alias("hit")
    )


def calibration_table(pairs: DataFrame, keys: Sequence[str] = (), width: float = CALIBRATION_WIDTH) -> DataFrame:
    return (
        pairs.filter(F.col("p").isNotNull())
        .withColumn("bin", F.floor(F.col("p") / width).cast("int"))
        .groupBy(*keys, "bin")
        .agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("hit").alias("observed"))
        .withColumn("gap", F.col("observed") - F.col("predicted"))
    )


def calibration_verdict(
    table: DataFrame, keys: Sequence[str] = (), min_n: int = CALIBRATION_MIN_N,
    tolerance: float = CALIBRATION_TOLERANCE,
) -> DataFrame:
    """Worst bin among the large ones, how many are off either way, and whether it passes."""
    big = table.filter(F.col("n") >= min_n)
    return big.groupBy(*keys).agg(
        F.count("*").alias("n_bins"),
        F.max_by("bin", F.struct(F.abs(F.col("gap")), -F.col("bin"))).alias("worst_bin"),
        F.max(F.abs(F.col("gap"))).alias("worst_gap"),
        F.count_if(F.col("observed") < F.col("predicted") - 0.01).alias("n_over"),
        F.count_if(F.col("observed") > F.col("predicted") + 0.01).alias("n_under"),
        (F.max(F.abs(F.col("gap"))) <= tolerance).alias("passed"),
    )


def longshot_bias(pairs: DataFrame, keys: Sequence[str] = (), below: float = LONGSHOT_BELOW) -> DataFrame:
    low = pairs.filter(F.col("p") < below)
    return low.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("p") - F.col("hit")).alias("bias"))


def macro_auc(df: DataFrame, probs: Column, outcome: Column, slices: int = 4096) -> DataFrame:
    """One-vs-rest AUC by average ranks, averaged over the classes that have both labels.

    Ranks need a global order. Scores are first counted per distinct value, then prefix-summed in
    two levels (inside a slice of [0, 1], and over slices), so no task sees more than a slice.
    """
    scored = df.select(outcome.alias("_o"), F.posexplode(probs).alias("klass", "score"))
    values = keep(
        scored.withColumn("pos", F.when(F.col("klass") == F.col("_o"), 1).otherwise(0))
        .groupBy("klass", "score")
        .agg(F.count("*").alias("n"), F.sum("pos").alias("pos"))
        .withColumn("slice", F.floor(F.col("score") * slices).cast("int"))
    )
    sizes = values.groupBy("klass", "slice").agg(F.sum("n").alias("slice_n"))
    over_slices = W.partitionBy("klass").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("slice_n").over(over_slices), F.lit(0))).drop("slice_n")
    inside = W.partitionBy("klass", "slice").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        values.withColumn("local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(starts, ["klass", "slice"])
        .withColumn("avg_rank", F.col("start") + F.col("local") + (F.col("n") + 1) / 2.0)
    )
    by_class = ranked.groupBy("klass").agg(
        F.sum(F.col("avg_rank") * F.col("pos")).alias("rank_sum"),
        F.sum("pos").alias("n_pos"),
        (F.sum("n") - F.sum("pos")).alias("n_neg"),
    )
    both = by_class.filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    auc = (F.col("rank_sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0) / (
        F.col("n_pos").cast("double") * F.col("n_neg")
    )
    return both.agg(F.count("*").alias("n_classes"), F.avg(auc).alias("auc"))


def backtest_verdicts(means: DataFrame, calibration: DataFrame, leak_ok: Column | None = None) -> DataFrame:
    """Criterion rows: value and pass/fail. ``means`` is one row with model, market, freq, uniform."""
    one = means.crossJoin(calibration.select("worst_gap"))  # both sides are single rows
    gap = F.try_divide((F.col("model") - F.col("market")) * 100.0, F.col("market"))
    vs = lambda c: F.try_divide(F.col(c) - F.col("model"), F.col(c))
    rows = [
        ("gap_to_market_pct", gap, gap < 2.0),
        ("gain_vs_freq", vs("freq"), vs("freq") >= CLEAR_MARGIN),
        ("gain_vs_uniform", vs("uniform"), vs("uniform") >= CLEAR_MARGIN),
        ("worst_calibration_gap", F.col("worst_gap"), F.col("worst_gap") <= CALIBRATION_TOLERANCE),
        ("beats_market_suspect", F.col("market") - F.col("model"), ~(F.col("model") < F.col("market"))),
    ]
    if leak_ok is not None:
        rows.append(("all_degraded", F.lit(None).cast("double"), leak_ok))
    packed = F.array(
        *[F.struct(F.lit(n).alias("criterion"), v.alias("value"), ok.alias("passed")) for n, v, ok in rows]
    )
    return one.select(F.inline(packed))


def monthly_metrics(df: DataFrame) -> DataFrame:
    """Monitoring metrics per month plus a total row (month 'all').

    Needs: date, outcome, probs, market (triple or NULL), predicted and actual score text.
    """
    o, p, m = F.col("outcome"), F.col("probs"), F.col("market")
    rows = df.withColumn("month", F.date_format("date", "yyyy-MM"))
    return (
        rows.rollup("month")
        .agg(
            F.count("*").alias("n"),
            F.avg(brier(p, o)).alias("brier"),
            F.avg(F.when(m.isNotNull(), brier(m, o))).alias("brier_market"),
            F.count_if(m.isNotNull()).alias("n_market"),
            F.avg(ranked_score(p, o)).alias("rps"),
            F.avg(F.when(F.col("predicted_outcome") == o, 1.0).otherwise(0.0)).alias("issue_rate"),
            F.avg(F.when(F.col("predicted_score") == F.col("actual_score"), 1.0).otherwise(0.0)).alias("exact_rate"),
            F.avg(p[1]).alias("draw_predicted"),
            F.avg(F.when(o == 1, 1.0).otherwise(0.0)).alias("draw_observed"),
        )
        .withColumn("month", F.coalesce("month", F.lit("all")))
    )


def promoted_split(rows: DataFrame, promoted: DataFrame) -> DataFrame:
    """Scores of the matches with a newly promoted team against the others.

    ``rows``: league, season, home, away, score, reference (NULL without a market). ``promoted``:
    league, season, team. The gap in % is taken over rows with both scores.
    """
    out = rows
    for side in ("home", "away"):
        new = promoted.select("league", "season", F.col("team").alias(side), F.lit(True).alias(f"_{side}"))
        out = out.join(new, ["league", "season", side], "left")
    flag = F.coalesce("_home", F.lit(False)) | F.coalesce("_away", F.lit(False))
    quoted = F.col("reference").isNotNull()
    paired = F.avg(F.when(quoted, F.col("score")))
    return out.groupBy(flag.alias("promoted")).agg(
        F.count("*").alias("n"), F.avg("score").alias("brier"), F.avg("reference").alias("brier_market"),
        F.try_divide((paired - F.avg("reference")) * 100.0, F.avg("reference")).alias("gap_pct"),
    )
