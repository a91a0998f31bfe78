"""Tolerance, nearest-date and as-of joins, all as equi-joins or combinable aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import ISSUES, SETTLE_TOLERANCE_DAYS, SHARP_BOOK

FIXTURE = ("league", "home", "away")
MEETING = (*FIXTURE, "commence_date")  # a fixture is played every season: one meeting of it
# direct orientation before swapped; same day, then earlier before later
DELTAS = (0, -1, 1, -2, 2)


SPAN = 8  # days in a bucket of match_xg


def match_xg(matches: DataFrame, source: DataFrame) -> DataFrame:
    """One row per matched source row: seq, and the (date, home, away) it lands on, with its xG.

    A pairing's match days and orientations are gathered by buckets of ``SPAN`` days, those within reach of a bucket
    included: a short list whatever the rows. A source row meets the list of its own bucket and takes the first of its
    ten candidates (five shifts, two orientations, in priority order) found there, so no row is copied.
    """
    reach, epoch = max(DELTAS), F.lit("1970-01-01").cast("date")
    bucket = lambda day: F.floor(day / SPAN)

    def paired(rows: DataFrame) -> DataFrame:
        lo, day = F.least("home", "away"), F.datediff("date", epoch)
        return rows.dropna(subset=["date", "home", "away"]).withColumns({
            "_lo": lo, "_hi": F.greatest("home", "away"), "_day": day, "_side": F.when(F.col("home") == lo, 0).otherwise(1)})

    ends = F.array(bucket(F.col("_day") - reach), bucket(F.col("_day") + reach))
    keys = paired(matches.select("date", "home", "away")).withColumn("_bucket", F.explode(F.array_distinct(ends)))
    lists = keys.groupBy("_lo", "_hi", "_bucket").agg(F.collect_set(F.col("_day") * 2 + F.col("_side")).alias("_found"))
    place = lambda i: (F.col("_day") + DELTAS[i % 5]) * 2 + (F.col("_side") if i < 5 else 1 - F.col("_side"))
    prio = F.coalesce(*[F.when(F.array_contains("_found", place(i)), i) for i in range(2 * len(DELTAS))])
    hits = paired(source).withColumn("_bucket", bucket(F.col("_day"))).join(lists, ["_lo", "_hi", "_bucket"]).withColumn("prio", prio).filter("prio IS NOT NULL")
    shift, swapped = F.array(*[F.lit(d) for d in DELTAS])[F.col("prio") % 5], F.col("prio") >= 5
    turned = {c: F.when(swapped, F.col(o)).otherwise(F.col(c)).alias(c) for c, o in (("home", "away"), ("away", "home"), ("xg_home", "xg_away"), ("xg_away", "xg_home"))}
    landed = hits.select("seq", F.date_add("date", shift).alias("date"), *turned.values(), "prio")
    best = F.min_by(F.struct("date", "home", "away", "xg_home", "xg_away", "prio"), F.col("prio"))
    return landed.groupBy("seq").agg(best.alias("r")).select("seq", "r.*")


def apply_xg(matches: DataFrame, source: DataFrame) -> DataFrame:
    """Matches with xG set from the last source row (by seq) that lands on them."""
    from .merge import last_per_key, update_xg

    landed = last_per_key(match_xg(matches, source), ["date", "home", "away"], ["seq"])
    return update_xg(matches, landed.select("date", "home", "away", "xg_home", "xg_away"))


def unmatched_xg(matches: DataFrame, source: DataFrame) -> DataFrame:
    return source.join(match_xg(matches, source).select("seq"), "seq", "left_anti")


def nearest_result(
    bets: DataFrame, matches: DataFrame, payload: Sequence[str], id_col: str = "bet_id",
    tolerance: int = SETTLE_TOLERANCE_DAYS,
) -> DataFrame:
    """Each bet with the closest played match of the same fixture within the tolerance.

    Of a fixture's results on a day only the lowest match id can win, so results collapse to one row per fixture and day before
    their 2 * tolerance + 1 dated copies; the best of these per fixture and day meets each bet once, however many matches a
    fixture has. Ties go to the earlier date, then the lower match id. Bets without a match keep NULLs.
    """
    rank = F.struct(F.abs("shift"), "on_date", "match_id")
    played = matches.filter("fthg IS NOT NULL AND ftag IS NOT NULL").select(
        *FIXTURE, F.col("date").alias("on_date"), "match_id", F.struct(*payload).alias("_p")
    )
    first = F.min_by(F.struct("match_id", "_p"), F.struct("match_id"))  # a struct, so that a NULL id comes first and isn't left out
    daily = played.groupBy(*FIXTURE, "on_date").agg(first.alias("_r")).select(*FIXTURE, "on_date", "_r.*")
    shifts = F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance))).alias("shift")
    reach = daily.select("*", shifts).withColumn("date", F.expr("date_sub(on_date, shift)"))
    best = F.min_by(F.struct("shift", "on_date", "match_id", "_p"), rank)
    near = reach.groupBy(*FIXTURE, "date").agg(best.alias("_n"))
    hits = bets.select(id_col, *FIXTURE, "date").join(near, [*FIXTURE, "date"]).select(id_col, "_n.*")
    found = hits.repartition(id_col).groupBy(id_col).agg(best.alias("_f"))  # sorted once, behind the shuffle
    return bets.join(
        found.select(
            id_col, F.col("_f.shift").alias("shift"), F.col("_f.on_date").alias("result_date"),
            F.col("_f.match_id").alias("result_id"), "_f._p.*",
        ),
        id_col, "left",
    )


def latest_snapshot(
    quotes: DataFrame, by: Sequence[str] = FIXTURE, book: str = SHARP_BOOK
) -> DataFrame:
    """Newest head-to-head snapshot of one book before kick-off for each meeting (``by`` and the
    kick-off's day), only when it has all three prices (s_home, s_draw, s_away).

    There is no fallback to an older snapshot that was complete. Two combinable aggregates: prices
    per (meeting, time), then the newest time per meeting; a duplicate price keeps the lowest.
    """
    live = quotes.filter(
        (F.col("book") == book) & (F.col("market") == "h2h") & (F.col("fetched_at") <= F.col("commence_time"))
    ).withColumn("commence_date", F.to_date("commence_time"))
    meeting = [*by, "commence_date"]
    names = [f"s_{i}" for i in ISSUES]
    prices = [F.min(F.when(F.col("outcome") == i, F.col("price"))).alias(n) for i, n in zip(ISSUES, names)]
    moments = live.groupBy(*meeting, "fetched_at").agg(*prices, F.max("commence_time").alias("commence_time"))
    newest = moments.groupBy(*meeting).agg(F.max(F.struct("fetched_at", "commence_time", *names)).alias("_s"))
    return newest.select(*meeting, "_s.*").dropna(subset=names)


def snapshot_for(targets: DataFrame, snapshots: DataFrame, id_col: str, by: Sequence[str] = FIXTURE) -> DataFrame:
    """Each target (id, fixture, date) with the snapshot of its meeting: kick-off on the day, or a
    day before or after, in this order. Adds the quote's age; targets without one are left out.

    Three dated copies of a meeting, the best per day, and an equi-join that targets enter once.
    """
    kept = [c for c in snapshots.columns if c not in by]
    rank = F.struct(F.abs("_shift"), "commence_date")
    shifts = F.explode(F.array(*[F.lit(d) for d in (0, -1, 1)])).alias("_shift")
    dated = snapshots.select("*", shifts).withColumn("date", F.expr("date_sub(commence_date, _shift)"))
    near = dated.groupBy(*by, "date").agg(F.min_by(F.struct("_shift", *kept), rank).alias("_n")).select(*by, "date", "_n.*")
    hits = targets.select(id_col, *by, "date").join(near, [*by, "date"])
    best = hits.repartition(id_col).groupBy(id_col).agg(F.min_by(F.struct("date", *kept), rank).alias("_b")).select(id_col, "_b.*")
    return best.withColumn("age_days", F.greatest(F.lit(0), F.datediff("date", F.to_date("fetched_at"))))


def best_prices(
    quotes: DataFrame, asof: Column | None = None, by: Sequence[str] = FIXTURE, totals_line: float | None = None
) -> DataFrame:
    """Highest price per outcome over every snapshot up to ``asof``, and the book that quoted it.

    Equal prices go to the newest snapshot, then to the first book name.
    """
    rows = quotes if asof is None else quotes.filter(F.col("fetched_at") <= asof)
    if totals_line is not None:
        rows = rows.filter((F.col("market") != "totals") | (F.col("point") == totals_line))
    top = F.max_by(F.struct("price", "book", "fetched_at"), F.struct("price", "fetched_at"))
    # the book only breaks what price and time leave open: take it by name among those rows
    exact = rows.groupBy(*by, "market", "outcome", "point", "price", "fetched_at").agg(F.min("book").alias("book"))
    return exact.groupBy(*by, "market", "outcome", "point").agg(top.alias("t")).select(
        *by, "market", "outcome", "point", "t.*"
    )


def promoted(matches: DataFrame) -> DataFrame:
    """(league, season, team) absent from the league's previous season; the first season is left out."""
    squads = (
        matches.select("league", "season", F.explode(F.array("home", "away")).alias("team")).distinct()
    )
    seasons = squads.select("league", "season").distinct()
    w = W.partitionBy("league").orderBy("season")
    pairs = seasons.withColumn("prev", F.lag("season").over(w)).filter("prev IS NOT NULL")
    before = squads.select("league", F.col("season").alias("prev"), "team")
    return squads.join(pairs, ["league", "season"]).join(before, ["league", "prev", "team"], "left_anti").select(
        "league", "season", "team"
    )


def with_strengths(fixtures: DataFrame, strengths: DataFrame, by: Sequence[str]) -> DataFrame:
    """Both teams' log strengths; an unknown team takes the group's mean strength.

    ``strengths``: by + (team, attack, defence, home_edge, rho, attack_mean, defence_mean).
    """
    common = strengths.groupBy(*by).agg(
        *[F.first(c).alias(c) for c in ("home_edge", "rho", "attack_mean", "defence_mean")]
    )
    out = fixtures.join(common, list(by))
    for side, tag in (("home", "h"), ("away", "a")):
        t = strengths.select(*by, F.col("team").alias(side), F.col("attack").alias(f"_at_{tag}"), F.col("defence").alias(f"_de_{tag}"))
        out = (
            out.join(t, [*by, side], "left")
            .withColumn(f"attack_{tag}", F.coalesce(f"_at_{tag}", "attack_mean"))
            .withColumn(f"defence_{tag}", F.coalesce(f"_de_{tag}", "defence_mean"))
            .drop(f"_at_{tag}", f"_de_{tag}")
        )
    return out


def expected_goals(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "lam_h": F.exp(F.col("attack_h") + F.col("defence_a") + F.col("home_edge")),
        "lam_a": F.exp(F.col("attack_a") + F.col("defence_h")),
    })
