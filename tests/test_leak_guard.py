"""The guard inside the fold sums: a late training row fails the fit."""

import pytest
from pyspark.sql import functions as F

from oddsloom.operators import strengths as S


def matches(spark):
    rows = [(i, f"2000-01-{d:02d}", "A", 2000, f"T{i % 4}", f"T{(i + 1) % 4}", i % 3, i % 2) for i, d in enumerate(range(3, 29))]
    made = spark.createDataFrame(rows, "match_id int, day string, league string, season int, home string, away string, fthg int, ftag int")
    return made.withColumn("date", F.col("day").cast("date")).withColumns({"xg_home": F.lit(None).cast("double"), "xg_away": F.lit(None).cast("double")})


def folds(spark):
    return spark.createDataFrame([("A", "2000-01-17"), ("A", "2000-01-24")], "league string, week string").withColumn("week", F.col("week").cast("date"))


def test_fold_sums_read_earlier_days_only(spark):
    sums = S.fold_sums(matches(spark), folds(spark), [0.0]).groupBy("week").agg(F.sum("n").alias("n"))
    assert {str(r.week): r.n for r in sums.collect()} == {"2000-01-17": 14.0, "2000-01-24": 21.0}


def test_pairs_that_meet_later_have_empty_sums(spark):
    late = matches(spark).withColumn("home", F.when(F.col("match_id") == 20, "T9").otherwise(F.col("home")))
    assert S.fold_sums(late, folds(spark), [0.0]).filter("home = 'T9'").agg(F.sum("n")).first()[0] in (None, 0.0)


def test_planted_late_row_fails_the_fit(spark, monkeypatch):
    """A week that is dated before its own days lets rows of the fold's future into its sums."""
    monkeypatch.setattr(S, "monday", lambda day: F.date_sub(F.date_trunc("week", day).cast("date"), 7))
    with pytest.raises(Exception, match="on or after the reference date"):
        S.fit_all(matches(spark), folds(spark), S.grid_settings([0.0])).collect()
