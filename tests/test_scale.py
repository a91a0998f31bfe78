"""Steps that must not be done again and again: margins, bootstrap weights, scored rows, cells of result files."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsloom.functions import odds as O
from oddsloom.functions.calendar import mixed_date
from oddsloom.functions.mixing import mix_array
from oddsloom.operators import resample as R
from oddsloom.operators import settle as SE
from oddsloom.sources import files


def plan(df):
    return df._jdf.queryExecution().withCachedData().toString()


def test_a_margin_is_solved_once_in_an_expression(spark):
    rows = spark.createDataFrame([(2.1, 3.4, 3.6), (2.0, 4.0, 4.0), (None, 3.0, 3.0)], "h double, d double, a double")
    fair = rows.select(O.fair(F.array("h", "d", "a"), "power").alias("p"))
    assert fair._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
    got = [r.p for r in fair.collect()]
    assert sum(got[0]) == pytest.approx(1.0) and got[1] == [0.5, 0.25, 0.25] and got[2] is None


@pytest.mark.parametrize("rows,replicates", [(1, 1), (3, 5), (64, 1024), (67, 1031), (200, 10)])
def test_blocks_of_weights_add_what_single_weights_add(rows, replicates):
    ids = (np.arange(rows, dtype=np.int64) - 5) * 700_001
    values = np.stack([np.ones(rows), np.linspace(-1.0, 2.0, rows)])
    hashes = mix_array(mix_array(7, np.arange(replicates))[None, :], ids[:, None])
    weights = sum((hashes >= np.uint32(step)).astype(float) for step in R.STEPS)
    total = np.zeros((2, replicates))
    R.add_weighted(total, 7, ids, values)
    assert (total[0] == weights.sum(0)).all()
    assert np.allclose(total, values @ weights, rtol=0, atol=1e-9)


def test_large_weights_are_counted():
    """One row over many replicates meets weights above the commonly counted ones."""
    total = np.zeros((1, 200_000))
    R.add_weighted(total, 1, np.array([42]), np.ones((1, 1)))
    hashes = mix_array(mix_array(1, np.arange(200_000)), np.array([42]))
    assert total.max() > R.COMMON
    assert (total[0] == sum((hashes >= np.uint32(step)).astype(int) for step in R.STEPS)).all()


def test_summaries_read_kept_rows(spark):
    bets = spark.range(60).select("id", (F.col("id") % 7 / 10.0 - 0.2).alias("clv"))
    assert "InMemoryRelation" in plan(SE.clv_summary(bets, "clv", "id", resamples=50))
    third = F.array(*[F.lit(1.0 / 3.0)] * 3)
    entries = spark.range(90).select(
        "id", (F.col("id") % 3).cast("int").alias("outcome"), third.alias("probs"), F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)).alias("market"),
        (F.col("id") % 9).alias("odds_age_days"))
    assert "InMemoryRelation" in plan(SE.stale_alert(entries, "id", resamples=50))


def test_dates_of_every_format(spark):
    texts = ["05/03/98", "05/03/2001", "2001-03-05", "05/03/45", "31/02/98", "5/3/98", "", "n/a", "05-03-1998", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(mixed_date(F.col("t")).alias("d")).collect()
    days = [dt.date(1998, 3, 5), dt.date(2001, 3, 5), dt.date(2001, 3, 5), dt.date(2045, 3, 5)]
    assert [r.d for r in got] == days + [None] * 6


def test_lines_are_not_shuffled_to_meet_their_header(spark, tmp_path):
    (tmp_path / "9798_E0.csv").write_text('Date,HomeTeam,AwayTeam,FTHG,,PSCH,PSCD,PSCA,PC>2.5,PC<2.5\n05/03/98," A ",B,1,x,2.0,3.0,4.0,1.9,1.8\n06/03/98,C,D\n07/03/98,E,F,2,x,1,1,1,1,1,9\n,G,H,1\n')
    (tmp_path / "9899_F1.csv").write_text("HomeTeam,Date,AwayTeam,PSH,PSD,PSA\nI,2001-03-05,J,0,3,4\n")
    rows = files.scan_results(spark, str(tmp_path))
    steps = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in steps and "SortMergeJoin" not in steps
    got = {r.home: r for r in rows.collect()}
    assert set(got) == {"A", "C", "I"}
    assert (got["A"].odds_source, got["A"].ou25_over, got["A"].fthg, got["A"].league) == ("pinnacle_close", 1.9, 1, "E0")
    assert got["C"].fthg is None and got["C"].odds_h is None
    assert (got["I"].season, got["I"].away, got["I"].odds_h, got["I"].date) == ("9899", "J", 0.0, dt.date(2001, 3, 5))
    assert files.scan_opening_odds(spark, str(tmp_path)).count() == 0


def test_a_column_listed_twice_is_an_error(spark, tmp_path):
    (tmp_path / "9798_E0.csv").write_text("Date,HomeTeam,AwayTeam,FTHG,FTHG\n05/03/98,A,B,1,2\n")
    with pytest.raises(Exception, match="listed twice"):
        files.scan_results(spark, str(tmp_path)).collect()
