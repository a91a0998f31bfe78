"""Data-quality checks as result tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import CLOSING_SOURCES

BY = ("league", "season")
STALE_DAYS = 5
COMPLETENESS = ("odds_h", "ou25_over", "ah_line", "xg_home", "fthg", "hthg")


def share(test: Column) -> Column:
    """Percentage of rows that pass."""
    return F.avg(F.when(test, 100.0).otherwise(0.0))


def count_check(matches: DataFrame, expected: DataFrame, current_season) -> DataFrame:
    """Rows per (league, season) against the expected number; the running season is exempt."""
    actual = matches.groupBy(*BY).agg(F.count("*").alias("n"))
    out = expected.join(actual, list(BY), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("season") == current_season, "running").when(F.col("n") == F.col("expected"), "ok").otherwise("off")
    return out.withColumn("gap", F.col("n") - F.col("expected")).withColumn("status", status)


def duplicate_keys(matches: DataFrame) -> DataFrame:
    return matches.groupBy("date", "home", "away").agg(F.count("*").alias("n")).filter("n > 1")


def closing_share(matches: DataFrame, leagues: Sequence[str], closing_from) -> DataFrame:
    """Closing quotes in at least 99 % of rows; before closing quotes existed, any quote."""
    closing = share(F.col("odds_source").isin(list(CLOSING_SOURCES)))
    out = matches.filter(F.col("league").isin(list(leagues))).groupBy(*BY).agg(
        F.count("*").alias("n"), closing.alias("closing_pct"), share(F.col("odds_h").isNotNull()).alias("any_pct")
    )
    judged = F.when(F.col("season") < closing_from, F.col("any_pct")).otherwise(F.col("closing_pct"))
    return out.withColumn("passed", judged >= 99.0)


def completeness(matches: DataFrame, columns: Sequence[str] = COMPLETENESS) -> DataFrame:
    have = [c for c in columns if c in matches.columns]
    return matches.groupBy(*BY).agg(F.count("*").alias("n"), *[share(F.col(c).isNotNull()).alias(c) for c in have])


def xg_coverage(matches: DataFrame, leagues: Sequence[str], current_season) -> DataFrame:
    played = matches.filter(F.col("fthg").isNotNull() & F.col("league").isin(list(leagues)))
    out = played.groupBy(*BY).agg(
        F.count("*").alias("n"), F.count_if(F.col("xg_home").isNull()).alias("n_missing"), share(F.col("xg_home").isNotNull()).alias("pct")
    )
    return out.withColumn("passed", (F.col("pct") >= 95.0) | (F.col("season") == current_season))


def teams_missing_xg(matches: DataFrame, top: int = 15) -> DataFrame:
    """Teams most often in played rows without xG; equal counts by name."""
    rows = matches.filter("fthg IS NOT NULL AND xg_home IS NULL")
    counts = rows.select(F.explode(F.array("home", "away")).alias("team")).groupBy("team").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "team").limit(top)


def first_missing_xg(matches: DataFrame, top: int = 20) -> DataFrame:
    rows = matches.filter("fthg IS NOT NULL AND xg_home IS NULL").select("date", "match_id", "league", "home", "away")
    return rows.orderBy("date", "match_id").limit(top)


def secondary_table(matches: DataFrame, leagues: Sequence[str]) -> DataFrame:
    """Rows, played rows and closing share (of played) of the leagues outside the verdict."""
    closing = F.count_if(F.col("odds_source").isin(list(CLOSING_SOURCES)))
    return matches.filter(F.col("league").isin(list(leagues))).groupBy(*BY).agg(
        F.count("*").alias("n"), F.count("fthg").alias("n_played"),
        F.coalesce(F.try_divide(closing * 100.0, F.count("fthg")), F.lit(0.0)).alias("closing_pct"),
    )


def largest_gaps(matches: DataFrame) -> DataFrame:
    """Largest gap in days between match days of one (league, season); 0 when there are fewer than two."""
    days = matches.select(*BY, "date").distinct()
    step = F.datediff("date", F.lag("date").over(W.partitionBy(*BY).orderBy("date")))
    return days.withColumn("_g", step).groupBy(*BY).agg(F.coalesce(F.max("_g"), F.lit(0)).alias("largest_gap"))


def stagnation(before: DataFrame, after: DataFrame, expected: DataFrame, season, previous, today: date | str) -> DataFrame:
    """Leagues whose latest date of the season did not move and is older than usual.

    Unchanged by the run, season incomplete, and more days old than the longer of five days and the
    previous season's largest gap between match days.
    """
    last = lambda df, n: df.filter(F.col("season") == season).groupBy("league").agg(F.max("date").alias(n))
    done = after.filter(F.col("season") == season).groupBy("league").agg(F.count("*").alias("n"))
    gaps = largest_gaps(after.filter(F.col("season") == previous)).select("league", "largest_gap")
    want = expected.filter(F.col("season") == season).select("league", "expected")
    rows = (
        last(after, "max_date").join(last(before, "before"), "league", "left").join(done, "league")
        .join(gaps, "league", "left").join(want, "league", "left")
    )
    days = F.datediff(F.lit(str(today)).cast("date"), "max_date")
    limit = F.greatest(F.lit(STALE_DAYS), F.coalesce("largest_gap", F.lit(0)))
    unchanged = F.col("max_date").eqNullSafe(F.col("before"))
    open_season = F.coalesce(F.col("n") < F.col("expected"), F.lit(True))
    return rows.select("league", "max_date", days.alias("days"), limit.alias("threshold"),
                       (unchanged & open_season & (days > limit)).alias("stagnant"))


def calendar_coverage(seasons: DataFrame, today: Column) -> DataFrame:
    """Is the season that ``today`` belongs to among the configured ones, and is it the newest?"""
    from ..functions.calendar import season_start

    expected = season_start(today)
    return seasons.agg(F.max("season").alias("newest"), F.bool_or(F.col("season") == expected).alias("present")).withColumns({
        "expected": expected, "is_current": F.col("newest") == expected,
    })
