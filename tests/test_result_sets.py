"""Stored predictions side by side: common matches, replaced runs, sets that aren't paired."""

import pytest
from pyspark.sql import functions as F

from oddsloom.operators import result_sets as RS

SCHEMA = "model string, match_id long, league string, season int, outcome int, probs array<double>"


def store(spark, *rows):
    return spark.createDataFrame([(m, i, "A", 1, o, p) for m, i, o, p in rows], SCHEMA)


def test_common_matches_only(spark):
    made = store(spark, ("a", 1, 0, [0.5, 0.3, 0.2]), ("b", 1, 0, [0.2, 0.3, 0.5]), ("a", 2, 1, [0.1, 0.8, 0.1]), ("c", 1, 0, [1.0, 0.0, 0.0]))
    rows = RS.side_by_side(made, ["a", "b"]).collect()
    assert [(r.match_id, r.outcome, dict(r.sets)) for r in rows] == [(1, 0, {"a": [0.5, 0.3, 0.2], "b": [0.2, 0.3, 0.5]})]
    scores = {r.model: r for r in RS.comparison(made, ["a", "b"], "b").collect()}
    assert scores["a"].n == 1 and scores["a"].brier == pytest.approx(0.25 + 0.09 + 0.04) and scores["b"].gap_pct == 0


def test_put_replaces_a_run(spark):
    old = store(spark, ("a", 1, 0, [0.5, 0.3, 0.2]), ("b", 1, 0, [0.2, 0.3, 0.5]))
    rows = RS.put(old, store(spark, ("a", 1, 0, [0.9, 0.1, 0.0]))).collect()
    assert {(r.model, tuple(r.probs)) for r in rows} == {("a", (0.9, 0.1, 0.0)), ("b", (0.2, 0.3, 0.5))}


@pytest.mark.parametrize("extra", [("a", 1, 0, [0.4, 0.3, 0.3]), ("b", 1, 2, [0.4, 0.3, 0.3])])
def test_unpaired_sets_fail(spark, extra):
    made = store(spark, ("a", 1, 0, [0.5, 0.3, 0.2]), extra)
    with pytest.raises(Exception, match="paired"):
        RS.side_by_side(made, ["a", "b"]).withColumn("x", F.size("sets")).collect()


def test_rows_without_a_triple_stay_out(spark):
    rows = store(spark, ("a", 1, 0, None), ("a", 2, 0, [1.0, 0.0, 0.0]))
    assert RS.result_set(rows, "new", F.col("probs")).select("model", "match_id").collect() == [("new", 2)]
