"""Stored predictions of several models on the same matches: one row for each (model, match)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.outcomes import brier, correct, log_loss
from .merge import upsert

KEY = ("model", "match_id")


def result_set(rows: DataFrame, model: str, probs: Column) -> DataFrame:
    """The rows of one model that have a triple."""
    out = rows.withColumn("probs", probs).filter("probs IS NOT NULL")
    return out.select(F.lit(model).alias("model"), "match_id", "league", "season", "outcome", "probs")


def put(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store after a run: predictions of a (model, match) replace its earlier ones."""
    return upsert(store, new, KEY)


def side_by_side(store: DataFrame, models: Sequence[str]) -> DataFrame:
    """Matches that every model predicted: match_id, league, season, outcome, sets (a map from the model to its triple).

    One aggregation, however many models. A match that a model predicted twice, or that two models give different
    outcomes, fails the job: such sets aren't paired.
    """
    sets = store.filter(F.col("model").isin(list(models))).groupBy("match_id").agg(
        F.min("league").alias("league"), F.min("season").alias("season"), F.min("outcome").alias("outcome"), F.max("outcome").alias("_other"),
        F.count("*").alias("_n"), F.size(F.collect_set("model")).alias("_models"), F.sort_array(F.collect_list(F.struct("model", "probs"))).alias("_sets"))  # a row for each model
    paired = (F.col("_models") == F.col("_n")) & F.col("outcome").eqNullSafe(F.col("_other"))
    message = F.concat(F.lit("predictions of a match aren't paired: "), F.col("match_id").cast("string"))
    checked = sets.withColumn("match_id", F.when(paired, F.col("match_id")).otherwise(F.raise_error(message).cast("long")))
    return checked.filter(F.col("_n") == len(set(models))).select("match_id", "league", "season", "outcome", F.when(paired, F.map_from_entries("_sets")).alias("sets"))


def comparison(store: DataFrame, models: Sequence[str], reference: str) -> DataFrame:
    """n, Brier, log-loss, accuracy of each model over the common matches, and its gap to the reference in %."""
    p, o = F.col("probs"), F.col("outcome")
    long = side_by_side(store, models).select("outcome", F.explode("sets").alias("model", "probs"))
    scored = long.groupBy("model").agg(F.count("*").alias("n"), F.avg(brier(p, o)).alias("brier"), F.avg(log_loss(p, o)).alias("log_loss"), F.avg(correct(p, o)).alias("accuracy"))
    base = scored.filter(F.col("model") == reference).select(F.col("brier").alias("_base"))
    return scored.join(F.broadcast(base)).withColumn("gap_pct", F.try_divide((F.col("brier") - F.col("_base")) * 100.0, F.col("_base"))).drop("_base")


def paired_scores(store: DataFrame, model: str, reference: str) -> DataFrame:
    """match_id, league, season, and the Brier scores ``score`` and ``reference`` of two models on their common matches."""
    both = side_by_side(store, [model, reference])
    own = lambda m: brier(F.col("sets")[m], F.col("outcome"))
    return both.select("match_id", "league", "season", "outcome", own(model).alias("score"), own(reference).alias("reference"))
