"""Rows that meet in joins: matches of a fixture on one day collapse before dated copies are made, so bets don't meet all of them."""

import datetime as dt
import re

import pytest

from oddsloom.operators import joins as J


def day(i):
    return dt.date(2000, 1, 1) + dt.timedelta(days=i)


def copies_of(df):
    """The operators that dated copies are made from."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    below = [[re.sub(r"^[\s:+|-]*", "", x) for x in lines[i + 1 : i + 4]] for i, x in enumerate(lines) if "Generate explode" in x]
    return [next(x.split()[0] for x in b if not x.startswith(("Project", "Filter"))) for b in below]


@pytest.fixture(scope="module")
def played(spark):
    rows = [(None if i == 17 else i, "L", "A", "B" if i % 3 else "C", day(i * 7 % 11), i % 4 if i % 5 else None, i % 2) for i in range(40)]
    return spark.createDataFrame(rows, "match_id long, league string, home string, away string, date date, fthg int, ftag int")


@pytest.fixture(scope="module")
def bets(spark):
    rows = [(i if i < 50 else 3, "L", "A", "B" if i % 2 else "C", day(i % 17 - 3)) for i in range(52)] + [(None, "L", "A", "B", day(3))]
    return spark.createDataFrame(rows, "bet_id long, league string, home string, away string, date date")


def test_nearest_result_equals_a_search_of_all_pairs(played, bets):
    out = J.nearest_result(bets, played, ["fthg", "ftag"])
    assert copies_of(out) == ["Aggregate"]
    matches, best = [r for r in played.collect() if r.fthg is not None], {}
    for b in bets.collect():
        for m in matches:
            shift = (m.date - b.date).days
            if b.bet_id is not None and b.away == m.away and abs(shift) <= 2:
                rank = (abs(shift), m.date, -1 if m.match_id is None else m.match_id)
                found = (rank, (shift, m.match_id, m.fthg, m.ftag))
                best[b.bet_id] = min(best.get(b.bet_id, found), found, key=lambda x: x[0])
    want = [(b.bet_id, *best.get(b.bet_id, (0, (None,) * 4))[1]) for b in bets.collect()]
    got = [tuple(r) for r in out.select("bet_id", "shift", "result_id", "fthg", "ftag").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_snapshot_for_takes_the_nearest_meeting(spark, bets):
    rows = [("L", "A", "B", day(i), dt.datetime(2000, 1, 1) + dt.timedelta(days=i - 1), float(i)) for i in (0, 1, 5, 8)]
    snaps = spark.createDataFrame(rows, "league string, home string, away string, commence_date date, fetched_at timestamp, s_home double")
    out = J.snapshot_for(bets, snaps, "bet_id")
    got = {(r.bet_id, r.s_home, r.age_days) for r in out.collect()}
    best = {}
    for b in bets.collect():
        for _, home, away, on, at, price in rows:
            gap = (on - b.date).days
            if b.away == away and abs(gap) <= 1:
                rank = (abs(gap), on)
                best[b.bet_id] = min([*([best[b.bet_id]] if b.bet_id in best else []), (rank, price, max(0, (b.date - at.date()).days))])
    assert got == {(k, v[1], v[2]) for k, v in best.items()}
