"""Structured Streaming forms of snapshot ingest, latest snapshot and rating state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import ISSUES, SHARP_BOOK
from ..operators.joins import MEETING
from ..operators.ratings import RATED, advance

WATERMARK = "2 days"
SNAPSHOT_KEY = ("fetched_at", "league", "home", "away", "book", "market", "outcome", "line")


def read_quotes(spark: SparkSession, path: str, schema, files_per_batch: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def dedup_quotes(quotes: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """First copy of each quote; a missing line compares equal to a missing line.

    State is kept for the watermark only; a copy later than that passes, so the batch
    insert-or-ignore stays the authority over the stored table.
    """
    timed = quotes.withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    line = timed.withColumn("line", F.coalesce("point", F.lit(-1.0)))
    return line.withWatermark("fetched_at", watermark).dropDuplicatesWithinWatermark(list(SNAPSHOT_KEY)).drop("line")


def append_stream(stream: DataFrame, path: str, checkpoint: str):
    """Append to parquet, everything available now, then stop."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def snapshot_candidates(quotes: DataFrame, book: str = SHARP_BOOK) -> DataFrame:
    """Usable head-to-head prices of one book, one row per (meeting, moment) inside a batch."""
    live = quotes.filter(
        (F.col("book") == book) & (F.col("market") == "h2h") & (F.col("fetched_at") <= F.col("commence_time"))
    ).withColumn("commence_date", F.to_date("commence_time"))
    return live.groupBy(*MEETING, "fetched_at").agg(
        *[F.min(F.when(F.col("outcome") == i, F.col("price"))).alias(f"s_{i}") for i in ISSUES]
    )


def merge_moments(old: DataFrame, new: DataFrame) -> DataFrame:
    """Newest moment per meeting; prices of the same moment that came in pieces are put together."""
    names = [f"s_{i}" for i in ISSUES]
    both = old.unionByName(new).groupBy(*MEETING, "fetched_at").agg(*[F.min(n).alias(n) for n in names])
    newest = both.groupBy(*MEETING).agg(F.max(F.struct("fetched_at", *names)).alias("_s"))
    return newest.select(*MEETING, "_s.*")


def current(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The table that ``maintain_latest`` keeps: of each bucket the rows of its newest version."""
    rows = spark.read.parquet(folder)
    if before is not None:
        rows = rows.filter(F.col("version") < before)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))  # a row for each bucket
    return rows.join(F.broadcast(newest), ["bucket", "version"])


def maintain_latest(stream: DataFrame, folder: str, checkpoint: str, book: str = SHARP_BOOK, buckets: int = 64):
    """Keep the latest snapshot per meeting in ``<folder>/version=<batch>/bucket=<hash>``.

    A batch rewrites only the buckets that its meetings fall into, from their newest version before
    the batch, so one that is run again after a failure gives the same files. Read with ``current``.
    """
    empty = snapshot_candidates(stream.sparkSession.createDataFrame([], stream.schema), book)
    bucket = F.pmod(F.xxhash64(*MEETING), F.lit(buckets)).cast("int").alias("bucket")

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = snapshot_candidates(batch, book).select("*", bucket)
        touched = F.broadcast(new.select("bucket").distinct())  # ``buckets`` rows at most
        old = current(spark, folder, batch_id).drop("version") if batch_id > 0 else empty.select("*", bucket)
        fresh = merge_moments(old.join(touched, "bucket", "left_semi").drop("bucket"), new.drop("bucket"))
        out = fresh.select("*", bucket, F.lit(batch_id).alias("version")).repartition("bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "bucket").parquet(folder)

    return (
        stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def complete_only(latest: DataFrame) -> DataFrame:
    """A snapshot counts when it has all three prices; there is no older fallback."""
    return latest.dropna(subset=[f"s_{i}" for i in ISSUES])


RATING_OUTPUT = "pool string, match_id long, " + ", ".join(f"{c} double" for c in RATED)


class RatingProcessor(StatefulProcessor):
    """Ratings of one pool: four numbers per team in state, advanced match by match."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.teams = handle.getMapState("teams", "team string", "elo double, at_home double, away double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["date", "match_id"])
        state: dict = {}
        for team in pd.unique(pd.concat([pdf["home"], pdf["away"]])):
            if self.teams.containsKey((team,)):
                state[team] = tuple(self.teams.getValue((team,)))
        out = [advance(state, h, a, g) for h, a, g in zip(pdf["home"], pdf["away"], pdf["gap"])]
        for team, values in state.items():
            self.teams.updateValue((team,), tuple(float(v) for v in values))
        res = pd.DataFrame(out, columns=list(RATED))
        res.insert(0, "match_id", pdf["match_id"].to_numpy())
        res.insert(0, "pool", key[0])
        yield res

    def close(self) -> None:
        pass


def stream_ratings(matches: DataFrame, pool_col: str) -> DataFrame:
    """Ratings per match of a stream that delivers each pool in (date, match_id) order.

    Order across batches is the source's duty; inside a batch rows are sorted. Needs the RocksDB
    state store. A batch of one pool is what arrived since the last trigger.
    """
    rows = matches.select(
        F.col(pool_col).cast("string").alias("pool"), "date", "match_id", "home", "away",
        (F.col("fthg") - F.col("ftag")).cast("double").alias("gap"),
    )
    return rows.groupBy("pool").transformWithStateInPandas(
        statefulProcessor=RatingProcessor(), outputStructType=RATING_OUTPUT, outputMode="Append", timeMode="None"
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
