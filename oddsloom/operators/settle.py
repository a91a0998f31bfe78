"""Settlement and monitoring of theoretical and real bets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.outcomes import brier, outcome_of_text
from ..functions.staking import freshness_bucket
from ..session import keep
from . import resample as R



def _price(block: Column, issue: Column) -> Column:
    """Price of an outcome in a struct with home, draw, away."""
    return F.when(issue == "home", block["home"]).when(issue == "draw", block["draw"]).when(issue == "away", block["away"])


def settle_bets(journal: DataFrame) -> DataFrame:
    """Fill the open fields of every bet of a settled entry; filled fields never change.

    Needs bets (array), actual_score, closing (home, draw, away, source) and provisional (home,
    draw, away). P&L is stake * (odds - 1) or -stake. The closing-line value needs a sharp closing
    source; otherwise the reason is noted. The provisional value has a column of its own.
    """
    winner = F.element_at(F.array(*[F.lit(i) for i in K.ISSUES]), outcome_of_text(F.col("actual_score")) + 1)
    closing, snap = F.col("closing"), F.col("provisional")
    sharp = closing["source"] == K.SHARP_SOURCE
    why = F.when(closing.isNull(), "no_closing_odds").when(~F.coalesce(sharp, F.lit(False)), "source_not_sharp").otherwise("no_closing_odds")

    def settle(b: Column) -> Column:
        gain = F.when(b["issue"] == winner, b["stake_pct"] * (b["odds"] - 1.0)).otherwise(-b["stake_pct"])
        close = F.when(sharp, _price(closing, b["issue"]))
        value = F.round(b["odds"] / close - 1.0, 6)
        clv = F.coalesce(b["clv_pct"], value)
        return (
            b.withField("realized_pct", F.coalesce(b["realized_pct"], F.round(gain, 6)))
            .withField("clv_skipped", F.when(clv.isNull(), why))
            .withField("clv_pct", clv)
            .withField("clv_pct_provisional", F.coalesce(b["clv_pct_provisional"], F.round(b["odds"] / _price(snap, b["issue"]) - 1.0, 6)))
        )

    done = F.when(F.col("actual_score").isNotNull(), F.transform("bets", settle)).otherwise(F.col("bets"))
    return journal.withColumn("bets", done)


def sync_results(journal: DataFrame, teams: DataFrame, matches: DataFrame, snapshots: DataFrame, as_of: Column) -> DataFrame:
    """Results for past unsettled entries: score and closing block, or the reason they stay open.

    ``journal``: entry_id, match, competition, date, home, away (NULL when the key must be split;
    ``teams`` holds the split keys), actual_score. ``snapshots``: latest complete snapshot per
    meeting; an entry takes that of its own date, a day apart at most. Adds actual_score, closing, provisional, shift and ``pending_reason``.
    """
    from .joins import nearest_result, snapshot_for

    split = teams.select(F.col("league").alias("competition"), "match", F.col("home").alias("_h"), F.col("away").alias("_a"))
    known = journal.join(split, ["competition", "match"], "left").withColumns({
        "home": F.coalesce("home", "_h"), "away": F.coalesce("away", "_a"), "league": F.col("competition"),
    }).drop("_h", "_a")
    due = F.col("actual_score").isNull() & (F.col("date") < as_of)
    closing = F.when(
        F.col("odds_h").isNotNull() & F.col("odds_d").isNotNull() & F.col("odds_a").isNotNull(),
        F.struct(F.col("odds_h").alias("home"), F.col("odds_d").alias("draw"), F.col("odds_a").alias("away"), F.col("odds_source").alias("source")),
    )
    found = nearest_result(
        known.filter(due & F.col("home").isNotNull() & F.col("away").isNotNull()),
        matches.select("match_id", "league", "home", "away", "date", "fthg", "ftag", F.concat_ws("-", "fthg", "ftag").alias("score"), closing.alias("closing")),
        ["score", "closing"], id_col="entry_id",
    ).select("entry_id", "shift", "score", "closing")
    prices = F.struct(F.col("s_home").alias("home"), F.col("s_draw").alias("draw"), F.col("s_away").alias("away"))
    named = known.filter(F.col("home").isNotNull() & F.col("away").isNotNull())
    snap = snapshot_for(named, snapshots, "entry_id").select("entry_id", prices.alias("provisional"))
    out = known.join(found, "entry_id", "left").join(snap, "entry_id", "left")
    reason = F.when(due & (F.col("home").isNull() | F.col("away").isNull()), "teams_not_resolved").when(due & F.col("score").isNull(), "not_in_results")
    return out.withColumns({"pending_reason": reason, "actual_score": F.coalesce("actual_score", "score")}).drop("score", "league")


def last_open_entry(journal: DataFrame, results: DataFrame) -> DataFrame:
    """Which entry a manual result goes to: the last unsettled one of that match, case-insensitive."""
    live = journal.filter("actual_score IS NULL").withColumn("_key", F.lower("match"))
    last = live.groupBy("_key").agg(F.max("position").alias("position"))
    return results.withColumn("_key", F.lower("match")).join(last, "_key").drop("_key")


def record_results(journal: DataFrame, results: DataFrame) -> DataFrame:
    """The journal after results typed by hand (match, score): each goes to the last unsettled entry of that match, which is
    settled; all other entries stay as they are. A result without such an entry changes nothing (``unmatched_results``).

    ``journal``: position, match, actual_score and what ``settle_bets`` needs.
    """
    typed = last_open_entry(journal, results).groupBy("position").agg(F.min("score").alias("_score"))
    marked = journal.join(typed, "position", "left")
    written = marked.withColumn("actual_score", F.coalesce("actual_score", "_score"))
    settled = settle_bets(written.withColumn("_old", F.col("bets")))
    return settled.withColumn("bets", F.when(F.col("_score").isNotNull(), F.col("bets")).otherwise(F.col("_old"))).drop("_score", "_old")


def unmatched_results(journal: DataFrame, results: DataFrame) -> DataFrame:
    """Typed results for which no unsettled entry is left."""
    live = journal.filter("actual_score IS NULL").select(F.lower("match").alias("_key")).distinct()
    return results.withColumn("_key", F.lower("match")).join(live, "_key", "left_anti").drop("_key")


def flat_bets(journal: DataFrame, keep: list[str]) -> DataFrame:
    return journal.select(*keep, F.explode("bets").alias("b")).select(*keep, "b.*")


def roi_summary(bets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Settled bets: count, staked, P&L, ROI in %, and whether the sample is too small."""
    settled = bets.filter("realized_pct IS NOT NULL")
    aggs = [F.count("*").alias("n"), F.sum("stake_pct").alias("staked"), F.sum("realized_pct").alias("pnl")]
    out = settled.groupBy(*keys).agg(*aggs) if keys else settled.agg(*aggs)
    return out.withColumns({
        "roi_pct": F.try_divide(F.col("pnl") * 100.0, F.col("staked")), "small_sample": F.col("n") < K.ROI_MIN_BETS,
    })


def clv_summary(bets: DataFrame, column: str, id_col: str, resamples: int = K.RESAMPLES) -> DataFrame:
    """Closing-line value: n, mean, share above 0, interval and reading."""
    rows = keep(bets.filter(F.col(column).isNotNull()).select(id_col, column))  # read by the mean, its draws and the share
    ci = R.mean_interval(rows, column, id_col, resamples=resamples)
    up = rows.agg(F.avg(F.when(F.col(column) > 0, 1.0).otherwise(0.0)).alias("positive_share"))
    reading = (
        F.when(F.col("n") == 0, "none").when(F.col("n") < K.CLV_MIN_BETS, "indicative")
        .when(~F.coalesce("excludes_zero", F.lit(False)), "contains_zero").when(F.col("point") < 0, "negative").otherwise("positive")
    )
    return ci.join(F.broadcast(up)).withColumn("reading", reading)  # single rows


def clv_skipped(bets: DataFrame) -> DataFrame:
    """Settled bets without a closing-line value, by reason."""
    rows = bets.filter("clv_pct IS NULL AND realized_pct IS NOT NULL")
    return rows.groupBy(F.coalesce("clv_skipped", F.lit("no_closing_odds")).alias("reason")).agg(F.count("*").alias("n"))


def _scored_by_age(entries: DataFrame, id_col: str) -> DataFrame:
    """id, bucket of the quote's age and both scores, kept: table, points and draws read them several times."""
    return keep(entries.select(
        id_col, freshness_bucket(F.col("odds_age_days")).alias("bucket"), brier(F.col("probs"), F.col("outcome")).alias("score"),
        F.when(F.col("market").isNotNull(), brier(F.col("market"), F.col("outcome"))).alias("reference"),
    ))


def freshness_table(entries: DataFrame, id_col: str, resamples: int = K.RESAMPLES) -> DataFrame:
    """Brier against the market by quote age, with a paired interval per bucket.

    ``entries``: id, outcome, probs, market (triple or NULL), odds_age_days. Buckets under the
    minimum size, or with too few quoted rows, give no gap.
    """
    rows = _scored_by_age(entries, id_col)
    paired = rows.filter("reference IS NOT NULL")
    ci = R.paired_gap_interval(paired, "score", "reference", id_col, ["bucket"], resamples=resamples).select("bucket", "lo", "hi")
    table = rows.groupBy("bucket").agg(
        F.count("*").alias("n"), F.avg("score").alias("brier"), F.avg("reference").alias("brier_market"), F.count("reference").alias("n_market")
    ).join(ci, "bucket", "left")
    usable = (F.col("n") >= K.BUCKET_MIN_N) & (F.col("n_market") >= K.BUCKET_MIN_N)
    gap = F.try_divide((F.col("brier") - F.col("brier_market")) * 100.0, F.col("brier_market"))
    return table.withColumns({
        "gap_pct": F.when(usable, gap), "lo": F.when(usable, F.col("lo")), "hi": F.when(usable, F.col("hi")),
    })


def stale_alert(entries: DataFrame, id_col: str, resamples: int = K.RESAMPLES) -> DataFrame:
    """Stale minus fresh gap: an alert needs more than three points and an interval without 0.

    The point is the difference of the two gaps of ``freshness_table``; a bucket with fewer rows, or
    fewer quoted rows, than the minimum has no gap, and then there is no point, interval or alert.
    """
    rows = _scored_by_age(entries, id_col)
    sides = {}
    for side in ("stale", "fresh"):
        one = F.col("bucket") == side
        usable = (F.count_if(one) >= K.BUCKET_MIN_N) & (F.count(F.when(one, F.col("reference"))) >= K.BUCKET_MIN_N)
        score, reference = F.avg(F.when(one, F.col("score"))), F.avg(F.when(one, F.col("reference")))
        sides[side] = F.when(usable, F.try_divide((score - reference) * 100.0, reference))
    point = rows.agg((sides["stale"] - sides["fresh"]).alias("point"))
    quoted = rows.filter("reference IS NOT NULL")
    ci = R.gap_difference_interval(quoted.filter("bucket = 'stale'"), quoted.filter("bucket = 'fresh'"), "score", "reference", id_col, resamples=resamples)
    both = ci.drop("point").join(F.broadcast(point))  # single rows
    shown = F.col("point").isNotNull()
    alert = (F.col("point") > K.STALE_ALERT_PTS) & F.coalesce("excludes_zero", F.lit(False))
    return both.select(
        "n", "point", *[F.when(shown, F.col(c)).alias(c) for c in ("lo", "hi", "excludes_zero")], F.when(shown, alert).alias("alert"))


def focus_month(monthly: DataFrame, month: str | None = None) -> DataFrame:
    """Reading of one month (the latest by default): draw gap and verdict against the market."""
    months = monthly.filter("month <> 'all'")
    if month is None:
        one = months.agg(F.max_by(F.struct(*monthly.columns), "month").alias("r")).select("r.*")
    else:
        one = months.filter(F.col("month") == month)
    draw = F.col("draw_observed") - F.col("draw_predicted")
    gap = F.col("brier") - F.col("brier_market")
    verdict = (
        F.when(F.col("brier_market").isNull(), "no_market").when(F.col("n_market") < K.BUCKET_MIN_N, "too_small")
        .when(gap < -0.01, "beats_market").when(gap > 0.01, "market_better").otherwise("equal")
    )
    return one.withColumns({
        "draw_gap": draw, "draws": F.when(F.abs(draw) > K.DRAW_GAP_ALERT, F.when(draw > 0, "underestimated").otherwise("overestimated")).otherwise("ok"),
        "verdict": verdict, "small_sample": F.col("n") < K.BUCKET_MIN_N,
    })


def real_pnl(bets: DataFrame) -> DataFrame:
    """Real bets: counts by status, P&L, ROI over wins and losses, slippage over rows with both odds."""
    status = F.coalesce("result", F.lit("pending"))
    win, loss = status == "win", status == "loss"
    pnl = F.when(win, F.col("stake") * (F.col("taken_odds") - 1.0)).when(loss, -F.col("stake"))
    both = F.col("journal_odds").isNotNull() & F.col("taken_odds").isNotNull() & (F.col("journal_odds") != 0) & (F.col("taken_odds") != 0)
    out = bets.agg(
        F.count("*").alias("n_total"), *[F.count_if(status == s).alias(f"n_{s}") for s in ("win", "loss", "void", "pending")],
        F.coalesce(F.sum(pnl), F.lit(0.0)).alias("pnl"), F.sum(F.when(win | loss, F.col("stake"))).alias("_staked"),
        F.avg(F.when(both, F.col("journal_odds") / F.col("taken_odds") - 1.0)).alias("mean_slippage"), F.count_if(both).alias("n_slippage"),
    )
    return out.withColumns({
        "roi_pct": F.try_divide(F.col("pnl") * 100.0, F.col("_staked")), "small_sample": F.col("n_win") + F.col("n_loss") < K.REAL_MIN_BETS,
    }).drop("_staked")
