"""Upserts, duplicate handling and change classification as joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .windows import rank_within


def last_per_key(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; partial aggregation keeps one row per key and task."""
    rest = [c for c in batch.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return batch.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*")


def first_per_key(batch: DataFrame, keys: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    cols = batch.columns
    oldest = F.min_by(F.struct(*cols), F.struct(*order))
    names = [F.col(k) if isinstance(k, str) else k for k in keys]
    return batch.groupBy(*[c.alias(f"_k{i}") for i, c in enumerate(names)]).agg(oldest.alias("_r")).select("_r.*")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same keys; the rest stays."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """Append the rows whose key is not there yet; inside a batch the first row by ``order`` wins."""
    fresh = first_per_key(new, keys, order)
    tag = lambda df: df.withColumn("_key", F.struct(*keys))
    return tag(fresh).join(tag(old).select("_key"), "_key", "left_anti").drop("_key")


def snapshot_keys() -> list[Column]:
    """Identity of a quoted price; a missing line compares equal to a missing line."""
    return [F.col(c) for c in ("fetched_at", "league", "home", "away", "book", "market", "outcome")] + [
        F.coalesce(F.col("point"), F.lit(-1.0)).alias("line")
    ]


def upsert_matches(
    matches: DataFrame, batch: DataFrame, order: Sequence[str], keep: Sequence[str] = ("xg_home", "xg_away"),
    keys: Sequence[str] = ("date", "home", "away"), id_col: str = "match_id",
) -> DataFrame:
    """Replace every batch column on the key, keep the ``keep`` columns and the row id of old rows.

    New rows are numbered after the largest id, in key order.
    """
    incoming = last_per_key(batch, keys, order).drop(*[c for c in order if c not in keys])
    value_cols = [c for c in incoming.columns if c not in keys]
    renamed = incoming.withColumnsRenamed({c: f"_n_{c}" for c in value_cols}).withColumn("_hit", F.lit(True))
    joined = matches.join(renamed, list(keys), "left")
    changed = {c: F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in value_cols if c in matches.columns}
    known = joined.withColumns(changed).select(*matches.columns)
    fresh = incoming.join(matches.select(*keys), list(keys), "left_anti")
    top = matches.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    numbered = rank_within(fresh, [], list(keys), F.col("date"), "_new")
    inserted = numbered.join(F.broadcast(top)).withColumn(id_col, F.col("_top") + F.col("_new"))
    empty = {c: F.lit(None).cast(matches.schema[c].dataType) for c in matches.columns if c not in inserted.columns}
    return known.unionByName(inserted.withColumns(empty).select(*matches.columns))


def classify_changes(
    matches: DataFrame, batch: DataFrame, order: Sequence[str], keys: Sequence[str] = ("date", "home", "away"),
    by: Sequence[str] = ("league", "season"),
) -> DataFrame:
    """Per group: rows read, inserted, updated, ignored, and the latest date afterwards.

    A repeated key counts against the row before it, as if the batch were applied in order.
    """
    cols = [c for c in batch.columns if c not in keys and c not in order]
    state = F.struct(*cols)
    w = W.partitionBy(*keys).orderBy(*order)
    seen = (
        batch.withColumn("_before", F.lag(state).over(w))
        .join(matches.select(*keys, state.alias("_stored")), list(keys), "left")
        .withColumn("_prev", F.coalesce("_before", "_stored"))
    )
    same = F.col("_prev").eqNullSafe(state)
    return seen.groupBy(*by).agg(
        F.count("*").alias("n_read"),
        F.count_if(F.col("_prev").isNull()).alias("n_inserted"),
        F.count_if(F.col("_prev").isNotNull() & ~same).alias("n_updated"),
        F.count_if(F.col("_prev").isNotNull() & same).alias("n_ignored"),
        F.max("date").alias("max_date"),
    )


def update_xg(matches: DataFrame, xg: DataFrame, keys: Sequence[str] = ("date", "home", "away")) -> DataFrame:
    """Set xG on existing rows only; adds ``xg_hit``. ``xg`` has one row per key."""
    new = xg.select(*keys, F.col("xg_home").alias("_h"), F.col("xg_away").alias("_a"), F.lit(True).alias("_hit"))
    joined = matches.join(new, list(keys), "left")
    hit = F.col("_hit").isNotNull()
    return joined.withColumns({
        "xg_home": F.when(hit, F.col("_h")).otherwise(F.col("xg_home")),
        "xg_away": F.when(hit, F.col("_a")).otherwise(F.col("xg_away")),
        "xg_hit": hit,
    }).drop("_h", "_a", "_hit")


def merge_journal(old: DataFrame, new: DataFrame) -> DataFrame:
    """One unsettled entry per (match, competition, season); the date is not part of the key.

    The first ``logged_at`` stays. When the stored entry has bets, they stay together with their
    exposure figures, so a re-run cannot move a price already taken. Settled entries are untouched.
    Both frames carry a ``season`` column.
    """
    keys = ["match", "competition", "season"]
    settled, live = old.filter("actual_score IS NOT NULL"), old.filter("actual_score IS NULL")
    payload = [c for c in new.columns if c not in keys]
    o = live.select(*keys, F.struct(*payload).alias("_o"))
    n = new.select(*keys, F.struct(*payload).alias("_n"))
    both = o.join(n, keys, "full_outer")
    has_bets = F.coalesce(F.size(F.col("_o.bets")) > 0, F.lit(False))

    def field(c: str) -> Column:
        old_v, new_v = F.col(f"_o.{c}"), F.col(f"_n.{c}")
        rerun = F.col("_o").isNotNull() & F.col("_n").isNotNull()
        if c == "logged_at":
            merged = F.when(rerun, old_v)
        elif c == "bets":
            merged = F.when(rerun & has_bets, old_v)
        elif c == "meta":
            kept = new_v.withField("exposure_factor", F.col("_o.meta.exposure_factor")).withField(
                "correlated_exposure", F.col("_o.meta.correlated_exposure")
            )
            merged = F.when(rerun & has_bets, kept)
        else:
            merged = F.when(F.lit(False), new_v)
        if c == "logged_at":
            return F.when(rerun, old_v).when(F.col("_n").isNull(), old_v).otherwise(new_v).alias(c)
        return F.coalesce(merged, F.when(F.col("_n").isNull(), old_v).otherwise(new_v)).alias(c)

    merged = both.select(*keys, *[field(c) for c in payload])
    return settled.unionByName(merged)

