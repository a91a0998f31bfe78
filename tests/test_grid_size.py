"""The validation grid scores a pairing's week once, and gives the mean over all of its matches."""

import pytest
from pyspark.sql import functions as F

from oddsloom.functions.outcomes import brier
from oddsloom.operators import forecasts as FC
from oddsloom.operators import strengths as S
from oddsloom.operators import tuning as U


@pytest.fixture(scope="module")
def played(spark):
    i = F.col("id")
    rows = spark.range(600).select(
        i.alias("match_id"), F.date_add(F.lit("2000-01-03").cast("date"), (i % 28).cast("int")).alias("date"), F.when(i % 28 < 14, 1999).otherwise(2000).alias("season"),
        F.lit("L").alias("league"), F.concat(F.lit("T"), i % 3).alias("home"), F.concat(F.lit("T"), (i + 1 + i % 2) % 3).alias("away"),
        (i * 7 % 5 % 4).alias("fthg"), (i * 11 % 3).alias("ftag"), F.lit(None).cast("double").alias("xg_home"), (i % 4 / 2.0).alias("xg_away"))
    return rows.union(rows.filter("match_id % 5 = 0")).cache()


def test_a_week_of_a_pairing_is_scored_once(played, monkeypatch):
    seen, settings = [], S.grid_settings([0.0, 0.002], [0.0, 0.6])
    want = FC.walk_forward(played, [2000], settings).groupBy("xi", "w").agg(F.count("*").alias("n"), F.avg(brier(F.col("model"), F.col("outcome"))).alias("brier"))
    want = {(r.xi, r.w): (r.n, pytest.approx(r.brier, abs=1e-12)) for r in want.collect()}
    for module in (FC, U):  # wherever the grid's forecasts are made
        if hasattr(module, "predict"):
            monkeypatch.setattr(module, "predict", lambda rows, strengths, made=FC.predict: seen.append(rows) or made(rows, strengths))
    got = {(r.xi, r.w): (r.n, r.brier) for r in U.validation_grid(played, [2000], settings).collect()}
    assert len(want) == 4 and got == want
    pairs = seen[0].select("week", "home", "away")
    assert pairs.count() == pairs.distinct().count() < played.filter("season = 2000").count() / 5
