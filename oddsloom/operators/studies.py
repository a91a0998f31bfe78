"""Signal studies composed from scores, resampling and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import odds as O
from ..functions.outcomes import brier, log_loss, total_variation
from ..session import keep
from . import resample as R
from . import tuning as U
from .metrics import calibration_pairs, longshot_bias


def margin_methods(rows: DataFrame, keys: Sequence[str], resamples: int = K.RESAMPLES, longshot_below: float = K.LONGSHOT_BELOW) -> DataFrame:
    """De-margin methods compared per group: scores, long-shot bias, paired gap to the power rule.

    ``rows``: match_id, outcome, odds (quoted triple) and the key columns.
    """
    methods = tuple(O.FAIR_METHODS)
    fair = rows.select("match_id", "outcome", *keys, *[O.fair(F.col("odds"), m).alias(m) for m in methods])
    fair = keep(fair)
    packed = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("probs"), F.col("power").alias("_base")) for m in methods])
    long = fair.select("match_id", "outcome", *keys, F.inline(packed))
    p, o = F.col("probs"), F.col("outcome")
    scored = long.select(*keys, "method", "match_id", "outcome", "probs", brier(p, o).alias("score"), brier(F.col("_base"), o).alias("base"), log_loss(p, o).alias("loss"))
    table = scored.groupBy(*keys, "method").agg(F.count("*").alias("n"), F.avg("score").alias("brier"), F.avg("loss").alias("log_loss"))
    low = longshot_bias(calibration_pairs(scored, p, o, [*keys, "method"]), [*keys, "method"], longshot_below).withColumnRenamed("n", "n_longshots")
    gaps = R.paired_gap_interval(scored, "score", "base", "match_id", [*keys, "method"], resamples=resamples)
    return table.join(low, [*keys, "method"], "left").join(gaps.drop("n"), [*keys, "method"], "left")


def blend_by_age(validation: DataFrame, test: DataFrame, ages: Sequence[int] = K.BLEND_AGES) -> DataFrame:
    """Test Brier per quote age: current weights, the legacy schedule, tuned per-age and fixed weights.

    Weights are chosen on ``validation``; both frames hold model, close, open and outcome.
    """
    grid = U.weight_grid(U.blend_coefficients(validation, ages))
    oracle = U.oracle_weights(grid).select("age", F.col("w").alias("oracle_w"))
    fixed = U.best_fixed_weight(grid).select(F.col("w").alias("fixed_w"))
    scored = U.blend_coefficients(test, ages).join(oracle, "age").join(F.broadcast(fixed))  # a single row
    age = F.col("age")
    current, legacy = O.freshness_weight(age, F.lit(True)), O.legacy_weight(age)
    at = U.brier_at
    out = scored.select(
        "age", "n", current.alias("weight"), legacy.alias("legacy_weight"), "oracle_w", "fixed_w",
        at(current).alias("final"), at(legacy).alias("legacy"), at(F.lit(1.0)).alias("market"), F.col("base").alias("model"),
        at(F.col("oracle_w")).alias("oracle"), at(F.col("fixed_w")).alias("fixed"),
    )
    return out.withColumns({
        "excess": F.col("final") - F.least("market", "model"), "no_regression": F.col("final") <= F.col("legacy") + K.BLEND_TOLERANCE,
    })


def blend_summary(by_age: DataFrame) -> DataFrame:
    """Means over the ages, gain over the legacy schedule and the share of the possible gain."""
    means = by_age.agg(
        *[F.avg(c).alias(c) for c in ("final", "legacy", "oracle", "fixed", "market")],
        F.max("excess").alias("max_excess"), F.bool_and("no_regression").alias("no_regression"),
    )
    return means.withColumns({
        "gain_pct": F.try_divide((F.col("legacy") - F.col("final")) * 100.0, F.col("legacy")),
        "share_of_gain": F.try_divide(F.col("legacy") - F.col("final"), F.col("legacy") - F.col("fixed")),
    })


def value_bets(rows: DataFrame, probs: Column, odds: Column, reference: Column, movement_to: Column) -> DataFrame:
    """One bet per row on the best edge of ``model`` over ``probs``: edge, movement, roi.

    movement = movement_to - reference at the chosen outcome; rows without an edge drop out.
    """
    e = O.edges(F.col("model"), probs)
    picked = rows.withColumns({"_e": e, "_odds": odds, "_move": O.edges(movement_to, reference)})
    k = F.array_position("_e", F.array_max("_e")).cast("int") - 1
    at = lambda c: F.get(F.col(c), k)
    won = k == F.col("outcome")
    out = picked.filter(F.array_max("_e") > 0).withColumns({
        "issue": k, "edge": F.array_max("_e"), "movement": at("_move"), "roi": F.when(won, at("_odds") - 1.0).otherwise(-1.0),
    })
    return out.withColumn("convergent", F.col("movement") > 0).drop("_e", "_odds", "_move")


def opening_bets(rows: DataFrame) -> DataFrame:
    """Bets at the opening line; movement runs to the close."""
    return value_bets(rows, F.col("open"), F.col("open_odds"), F.col("open"), F.col("close"))


def taken_bets(rows: DataFrame, age: int = K.TAKEN_AGE_DAYS) -> DataFrame:
    """Bets at the price ``age`` days before kick-off; movement runs from the opening to that price."""
    fair, odds = O.aged_taken_odds(F.col("close"), F.col("open"), F.col("close_odds"), F.col("open_odds"), F.lit(age))
    return value_bets(rows, fair, odds, F.col("open"), fair)


def movement_study(bets: DataFrame, id_col: str = "match_id", resamples: int = K.RESAMPLES) -> DataFrame:
    """ROI of convergent against divergent bets with the interval of the difference."""
    groups = R.mean_interval(bets.withColumn("group", F.when(F.col("convergent"), "convergent").otherwise("divergent")), "roi", id_col, ["group"], resamples=resamples)
    diff = R.difference_interval(bets.filter("convergent"), bets.filter("NOT convergent"), "roi", id_col, resamples=resamples)
    verdict = F.coalesce("excludes_zero", F.lit(False)) & (F.col("point") > 0)
    return groups.withColumn("signal", F.lit(None).cast("boolean")).unionByName(
        diff.select(F.lit("difference").alias("group"), "n", "point", "lo", "hi", "excludes_zero", verdict.alias("signal"))
    )


def composite_run(bets: DataFrame, weight: float, threshold: float, id_col: str = "match_id", resamples: int = K.RESAMPLES, permutations: int = K.PERMUTATIONS) -> DataFrame:
    """Frozen selection on the test bets: both ROIs, interval of the lift, permutation p-value, verdict."""
    picked = bets.filter(F.col("edge") + weight * F.col("movement") > threshold)
    diff = R.difference_interval(picked, bets, "roi", id_col, resamples=resamples).select(
        F.col("point").alias("difference"), "lo", "hi", "excludes_zero"
    )
    perm = R.permutation_lift(bets, weight, threshold, id_col, permutations=permutations)
    one = perm.join(diff)  # both sides are single rows
    lifted = F.coalesce("excludes_zero", F.lit(False)) & (F.col("difference") > 0)
    return one.withColumn("confirmed", lifted & (F.col("p_value") < 0.05))


def fatigue_residuals(matches: DataFrame, rest: DataFrame) -> DataFrame:
    """(axis, rest_bucket, residual) rows: goals minus expected goals on four axes.

    ``matches``: match_id, fthg, ftag, lam_h, lam_a. ``rest``: match_id, is_home, rest_bucket. Teams
    without an earlier match give no row.
    """
    h, a = F.col("fthg") - F.col("lam_h"), F.col("ftag") - F.col("lam_a")
    attack = F.when(F.col("is_home"), h).otherwise(a)
    conceded = F.when(F.col("is_home"), a).otherwise(h)
    side = F.when(F.col("is_home"), "home").otherwise("away")
    items = F.array(
        F.struct(F.concat(side, F.lit("_attack")).alias("axis"), attack.alias("residual")),
        F.struct(F.concat(side, F.lit("_defence")).alias("axis"), conceded.alias("residual")),
    )
    return rest.filter("rest_bucket IS NOT NULL").join(matches, "match_id").select("match_id", "rest_bucket", F.inline(items))


def fatigue_table(residuals: DataFrame) -> DataFrame:
    """Mean residual and half-width of its interval per axis and rest bucket."""
    half = 1.96 * F.stddev_samp("residual") / F.sqrt(F.count("*"))
    return residuals.groupBy("axis", "rest_bucket").agg(F.count("*").alias("n"), F.avg("residual").alias("mean"), half.alias("half_width"))


def fatigue_test(residuals: DataFrame) -> DataFrame:
    return R.welch(residuals, "residual", F.col("rest_bucket") == "short", ["axis"])


def disagreement_rows(rows: DataFrame) -> DataFrame:
    """Per match: distance of two models, Brier of the first, its best edge and unit ROI at fair odds.

    ``rows``: match_id, outcome, first, second, market (triples).
    """
    edges = F.zip_with("first", "market", lambda p, m: F.when(m > 0, p / m - 1.0))
    one = rows.filter("market IS NOT NULL").select(
        "match_id", "outcome", total_variation(F.col("first"), F.col("second")).alias("distance"),
        brier(F.col("first"), F.col("outcome")).alias("score"), edges.alias("_e"), "market",
    )
    k = F.array_position("_e", F.array_max("_e")).cast("int") - 1
    won = k == F.col("outcome")
    return one.withColumns({
        "best_edge": F.array_max("_e"), "roi": F.when(won, 1.0 / F.get("market", k) - 1.0).otherwise(-1.0),
    }).drop("_e", "market")


def disagreement_study(rows: DataFrame, resamples: int = K.RESAMPLES) -> DataFrame:
    """High against low disagreement: Brier over all matches, ROI over value bets."""
    bucket = F.floor(F.col("distance") * 65536)
    rows = keep(rows)

    def angle(df: DataFrame, name: str, col: str) -> DataFrame:
        split = keep(R.median_split(df, "distance", "match_id", bucket))
        sizes = split.agg(
            F.count_if(F.col("half") == "low").alias("n_low"), F.count_if(F.col("half") == "high").alias("n_high"),
            F.avg(F.when(F.col("half") == "low", F.col(col))).alias("mean_low"), F.avg(F.when(F.col("half") == "high", F.col(col))).alias("mean_high"),
        )
        diff = R.difference_interval(split.filter("half = 'high'"), split.filter("half = 'low'"), col, "match_id", resamples=resamples)
        return sizes.join(diff.drop("n")).withColumn("angle", F.lit(name))  # single rows

    both = angle(rows, "brier", "score").unionByName(angle(rows.filter(F.col("best_edge") > K.VALUE_EDGE), "value_roi", "roi"))
    signal = F.when(F.col("angle") == "value_roi", F.coalesce("excludes_zero", F.lit(False)) & (F.col("point") < 0))
    return both.withColumn("signal", signal)


