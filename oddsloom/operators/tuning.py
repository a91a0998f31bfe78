"""Selection on validation rows, then freezing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import odds as O
from ..functions.outcomes import brier, outcome_index
from .baselines import with_week
from .forecasts import predict
from .strengths import SETTING, Setting, fit_all, settings_frame, target_folds


def validation_grid(played: DataFrame, seasons: Sequence, settings: Sequence[Setting]) -> DataFrame:
    """Mean Brier per setting: every (league, week, setting) fit runs in the same job.

    All matches of one pairing in a week share their forecast, so each setting scores a pairing's week once, weighted by the
    matches of each outcome: at most one row per pairing and week, whatever the number of matches.
    """
    strengths = fit_all(played, target_folds(played, seasons), settings)
    outcome = outcome_index(F.col("fthg"), F.col("ftag"))
    target = with_week(played.filter(F.col("season").isin(list(seasons))))
    counts = [F.count_if(outcome == k).cast("double").alias(f"n{k}") for k in range(3)]
    meetings = target.groupBy("league", "week", "home", "away").agg(F.count("*").alias("n"), *counts)
    loss = sum((F.col(f"n{k}") * brier(F.col("model"), F.lit(k)) for k in range(3)), F.lit(0.0))
    known = F.nullif(F.sum(F.col("n0") + F.col("n1") + F.col("n2")), F.lit(0.0))
    scores = predict(meetings, strengths).groupBy(*SETTING).agg(F.sum("n").alias("n"), (F.sum(loss) / known).alias("brier"))
    return scores.join(settings_frame(played.sparkSession, settings), list(SETTING))


def keep_default_unless(grid: DataFrame, default: float = K.KAPPA_DEFAULT, gain: float = K.KAPPA_MIN_GAIN) -> DataFrame:
    """Best kappa, unless it gains less than ``gain`` over the default."""
    at_default = F.max(F.when(F.col("kappa") == default, F.col("brier")))
    return grid.agg(
        F.min_by("kappa", F.struct("brier", "cell")).alias("_best"), F.min("brier").alias("_least"), at_default.alias("_default")
    ).select(
        F.when(F.col("_default") - F.col("_least") < gain, F.lit(default)).otherwise(F.col("_best")).alias("kappa"),
        F.col("_least").alias("brier"), F.col("_default").alias("brier_default"),
    )


def bounded_minimum(
    df: DataFrame, loss: Callable[[Column], Column], bounds: tuple[float, float] = K.TEMPERATURE_BOUNDS,
    keys: Sequence[str] = (), points: int = 41, passes: int = 4,
) -> DataFrame:
    """Per key, the t in bounds with the least mean loss, by zooming in on an even grid.

    Each pass is one aggregation: every row scores all candidates of its key in an array and the
    sums combine map-side. The interval shrinks by (points - 1) / 2 per pass. The state between
    passes is one row per key.
    """
    keyed = list(keys)
    base = df.withColumn("_one", F.lit(1)) if not keyed else df
    keyed = keyed or ["_one"]
    state = base.select(*keyed).distinct().withColumn("_lo", F.lit(float(bounds[0]))).withColumn("_hi", F.lit(float(bounds[1])))
    for _ in range(passes):
        step = (F.col("_hi") - F.col("_lo")) / float(points - 1)
        marks = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("_lo") + i * step)
        # one row per key: small by the number of keys, so it rides along with the rows
        spread = base.join(F.broadcast(state.select(*keyed, marks.alias("_marks"))), keyed)
        scored = spread.select(*keyed, F.posexplode("_marks").alias("_i", "_t"), *[c for c in base.columns if c not in keyed])
        means = scored.groupBy(*keyed, "_i", "_t").agg(F.avg(loss(F.col("_t"))).alias("_loss"), F.count("*").alias("n"))
        best = means.groupBy(*keyed).agg(F.min_by(F.struct("_t", "_loss", "n"), F.struct("_loss", "_i")).alias("_b"))
        rows = [r.asDict(recursive=True) for r in best.join(state, keyed).collect()]  # one row per key
        width = lambda r: (r["_hi"] - r["_lo"]) / (points - 1)
        nxt = [
            (*[r[k] for k in keyed], max(bounds[0], r["_b"]["_t"] - width(r)), min(bounds[1], r["_b"]["_t"] + width(r)),
             r["_b"]["_t"], r["_b"]["_loss"], r["_b"]["n"])
            for r in rows
        ]
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in keyed)
        state = df.sparkSession.createDataFrame(nxt, f"{fields}, _lo double, _hi double, t double, loss double, n long")
    return state.drop("_lo", "_hi", *([] if keys else ["_one"]))


def tune_temperature(df: DataFrame, **kw) -> DataFrame:
    """Temperature of a triple ``model`` against ``outcome``."""
    return bounded_minimum(df, lambda t: brier(O.temper(F.col("model"), t), F.col("outcome")), **kw)


def tune_binary_temperature(df: DataFrame, keys: Sequence[str] = ("market",), **kw) -> DataFrame:
    return bounded_minimum(df, lambda t: F.pow(O.temper_binary(F.col("raw_p"), t) - F.col("y"), 2.0), keys=keys, **kw)


def merge_frozen(frozen: DataFrame, tuned: DataFrame, key: str = "market") -> DataFrame:
    """Add newly tuned keys; a key that is already frozen is never touched."""
    return frozen.unionByName(tuned.join(frozen.select(key), key, "left_anti").select(*frozen.columns))


def require_frozen(frozen: DataFrame, wanted: DataFrame, key: str = "market") -> DataFrame:
    """The frozen rows of the wanted keys; a run with a missing key fails."""
    joined = wanted.select(key).distinct().join(frozen.withColumn("_have", F.lit(True)), key, "left")
    failed = F.raise_error(F.concat(F.lit("not frozen yet: "), F.col(key).cast("string"))).cast("boolean")
    return joined.withColumn("_have", F.coalesce("_have", failed)).filter("_have").drop("_have")


def composite_grid(bets: DataFrame, weights: Sequence[float], thresholds: Sequence[float]) -> DataFrame:
    """Mean ROI and size of the selection edge + w * movement > threshold over the whole grid.

    A bet passes every threshold below its score, so it is counted once per weight at the number of
    thresholds it passes; sums over the higher counts then give each cell.
    """
    marks = sorted(float(x) for x in thresholds)
    scored = bets.select(
        "roi", F.col("edge"), F.col("movement"), F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("w")
    ).select("w", "roi", (F.col("edge") + F.col("w") * F.col("movement")).alias("score"))
    passed = sum((F.when(F.col("score") > x, 1).otherwise(0) for x in marks), F.lit(0))
    counts = scored.groupBy("w", passed.alias("passed")).agg(F.count("*").alias("n"), F.sum("roi").alias("total"))
    cells = counts.select(
        "w", "n", "total",
        F.explode(F.slice(F.array(*[F.lit(x) for x in marks]), F.lit(1), F.col("passed"))).alias("threshold"),
    )
    return cells.groupBy("w", "threshold").agg(
        F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("roi")
    )


def best_composite(grid: DataFrame, min_n: int = K.MIN_BETS_FOR_TUNE) -> DataFrame:
    """Highest ROI among cells with enough bets; ties take the smallest (w, threshold)."""
    ok = grid.filter(F.col("n") >= min_n)
    return ok.agg(F.min_by(F.struct("w", "threshold", "n", "roi"), F.struct(-F.col("roi"), F.col("w"), F.col("threshold"))).alias("r")).select("r.*")


def blend_coefficients(rows: DataFrame, ages: Sequence[int] = K.BLEND_AGES) -> DataFrame:
    """Per age the three means that give the Brier of any market weight: quad, lin, base.

    The blend is linear in the weight, so its squared error is a quadratic: one pass instead of one
    aggregate per weight. ``rows``: model, close, open (fair triples) and outcome.
    """
    y = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.when(F.col("outcome") == k, 1.0).otherwise(0.0))
    aged = rows.select("model", "close", "open", y.alias("y"), F.explode(F.array(*[F.lit(a) for a in ages])).alias("age"))
    market = aged.select("age", "model", "y", O.aged_fair(F.col("close"), F.col("open"), F.col("age")).alias("market"))
    d = lambda k: F.col("market")[k] - F.col("model")[k]
    e = lambda k: F.col("model")[k] - F.col("y")[k]
    dot = lambda f, g: f(0) * g(0) + f(1) * g(1) + f(2) * g(2)
    return market.groupBy("age").agg(
        F.count("*").alias("n"), F.avg(dot(d, d)).alias("quad"), F.avg(dot(d, e)).alias("lin"), F.avg(dot(e, e)).alias("base")
    )


def brier_at(weight: Column) -> Column:
    """Mean Brier of the blend at a market weight, from ``blend_coefficients``."""
    return F.col("quad") * weight * weight + 2.0 * F.col("lin") * weight + F.col("base")


def weight_grid(coefficients: DataFrame, steps: int = 20) -> DataFrame:
    marks = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.round(i / float(steps), 2))
    return coefficients.select("*", F.explode(marks).alias("w")).withColumn("brier", brier_at(F.col("w")))


def oracle_weights(grid: DataFrame) -> DataFrame:
    """Best weight of each age; the smaller weight wins a tie."""
    return grid.groupBy("age").agg(F.min_by("w", F.struct("brier", "w")).alias("w"), F.min("brier").alias("brier"))


def best_fixed_weight(grid: DataFrame) -> DataFrame:
    """Best single weight over all ages, each age counting the same."""
    means = grid.groupBy("w").agg(F.avg("brier").alias("brier"))
    return means.agg(F.min_by("w", F.struct("brier", "w")).alias("w"), F.min("brier").alias("brier"))

