"""Streaming queries: files written from the views, read back as a stream until exhausted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_folder
from ..operators.joins import MEETING
from ..streaming import streams as S
from ..views import Tables
from .joining import SNAP_SQL
from .registry import query


def _quote_files(t: Tables) -> str:
    path = scratch_folder(t.spark, "quotes")
    t.book_odds.repartition(8, "league", "home", "away", "commence_time").write.parquet(path)
    return path


@query("stream_quote_dedup", "SELECT fetched_at, league, home, away, book, market, outcome, point, count(*) > 0 AS seen FROM book_odds_v GROUP BY ALL")
def stream_quote_dedup(t: Tables) -> DataFrame:
    """Quotes through the deduplicating stream: one row per key, as the batch insert gives."""
    path = _quote_files(t)
    # copies of a key arrive in one batch here: the whole backlog is one trigger
    quotes = S.read_quotes(t.spark, path, t.spark.read.parquet(path).schema, files_per_batch=1000)
    out = scratch_folder(t.spark, "deduped")
    S.append_stream(S.dedup_quotes(quotes), out, scratch_folder(t.spark, "dedup-log")).awaitTermination()
    rows = t.spark.read.parquet(out)
    return rows.select(F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"), "league", "home", "away", "book", "market", "outcome", "point", F.lit(True).alias("seen"))


@query("stream_latest_snapshot", f"WITH {SNAP_SQL} SELECT league, home, away, commence_date, fetched_at, h AS home_odds, d AS draw_odds, a AS away_odds FROM full_snap")
def stream_latest_snapshot(t: Tables) -> DataFrame:
    """Latest complete snapshot per meeting, maintained batch by batch."""
    path = _quote_files(t)
    quotes = S.read_quotes(t.spark, path, t.spark.read.parquet(path).schema, files_per_batch=3)
    folder = scratch_folder(t.spark, "latest")
    S.maintain_latest(quotes, folder, scratch_folder(t.spark, "latest-log")).awaitTermination()
    rows = S.complete_only(S.current(t.spark, folder))
    return rows.select(*MEETING, "fetched_at", F.col("s_home").alias("home_odds"), F.col("s_draw").alias("draw_odds"), F.col("s_away").alias("away_odds"))


@query("stream_ratings", "SELECT match_id, TRUE AS same FROM matches_v WHERE fthg IS NOT NULL")
def stream_ratings(t: Tables) -> DataFrame:
    """Ratings from the stateful stream against the batch fold, match by match."""
    from .featuring import pool_ratings

    path = scratch_folder(t.spark, "results")
    played = t.played.select("league", "date", "match_id", "home", "away", "fthg", "ftag")
    # one file per season, in season order
    season = F.year(F.add_months("date", -6))
    played.withColumn("season", season).repartitionByRange(8, "season").sortWithinPartitions("date", "match_id").drop("season").write.parquet(path)
    before = t.spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)
    try:
        stream = S.read_quotes(t.spark, path, t.spark.read.parquet(path).schema, files_per_batch=1000)
        out = scratch_folder(t.spark, "rated")
        S.append_stream(S.stream_ratings(stream, "league"), out, scratch_folder(t.spark, "rated-log")).awaitTermination()
    finally:
        if before is None:
            t.spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    streamed = t.spark.read.parquet(out).select("match_id", F.round("elo_home", 6).alias("elo_stream"), F.round("pi_home_attack", 6).alias("pi_stream"))
    batch = pool_ratings(t).select("match_id", F.round("elo_home", 6).alias("elo_batch"), F.round("pi_home_attack", 6).alias("pi_batch"))
    same = (F.col("elo_stream") == F.col("elo_batch")) & (F.col("pi_stream") == F.col("pi_batch"))
    return streamed.join(batch, "match_id").select("match_id", same.alias("same"))
