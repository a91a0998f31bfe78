"""Stakes, the weekly exposure cap and the coupon filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.staking import kelly

CONTEXT_RULES = (
    ("post_european_home", "post_european_away", "rotation"),
    ("coach_change_home", "coach_change_away", "coach_change"),
    ("weather_extreme", "weather_extreme", "weather"),
    ("low_stakes_home", "low_stakes_away", "low_stakes"),
)


def match_stakes(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per outcome with a positive stake: keep + (issue, odds, p, stake).

    Needs ``final`` and ``best_odds`` triples; fixtures without odds give no row.
    """
    items = [
        F.struct(
            F.lit(i).alias("issue"), F.col("best_odds")[k].alias("odds"), F.col("final")[k].alias("p"),
            kelly(F.col("final")[k], F.col("best_odds")[k]).alias("stake"),
        )
        for k, i in enumerate(K.ISSUES)
    ]
    return df.filter("best_odds IS NOT NULL").select(*keep, F.inline(F.array(*items))).filter("stake > 0")


def correlated_matches(items: DataFrame, week: Sequence[str] = ("week",), id_col: str = "item_id") -> DataFrame:
    """Ids of items with a team that another item of the same week also has."""
    teams = items.select(*week, id_col, F.explode(F.array("home", "away")).alias("team")).filter("team IS NOT NULL")
    shared = teams.groupBy(*week, "team").agg(F.count("*").alias("_n")).filter("_n > 1").select(*week, "team")
    return teams.join(shared, [*week, "team"], "left_semi").select(*week, id_col).distinct()


def pending_exposure(journal: DataFrame, rewritten: DataFrame) -> DataFrame:
    """Stake and bet count per week of unsettled entries with bets, without those being rewritten.

    ``rewritten``: (match, date) of the entries the current run replaces.
    """
    live = journal.filter("actual_score IS NULL AND n_bets > 0").join(rewritten, ["match", "date"], "left_anti")
    return live.groupBy("week").agg(F.sum("stake").alias("prior"), F.sum("n_bets").alias("prior_bets"))


def exposure_factors(run: DataFrame, pending: DataFrame, cap: float = K.EXPOSURE_CAP) -> DataFrame:
    """Per week: gross, effective gross, budget, common factor and state.

    ``run`` and ``pending``: item_id, week, home, away, stake, n_bets. A match that shares a team
    with another item of its week counts more against the cap; no stake is raised by that. One
    factor scales every stake of the week.
    """
    cols = ["item_id", "week", "home", "away", "stake", "n_bets"]
    pool = run.select(*cols, F.lit(True).alias("current")).unionByName(pending.select(*cols, F.lit(False).alias("current")))
    tied = correlated_matches(pool).withColumn("correlated", F.lit(True))
    marked = pool.join(tied, ["week", "item_id"], "left").withColumn("correlated", F.coalesce("correlated", F.lit(False)))
    now, tie = F.col("current"), F.col("correlated")
    total = lambda test, v: F.coalesce(F.sum(F.when(test, v)), F.lit(0.0))
    heavy = F.col("stake") * F.when(tie, K.CORRELATION_FACTOR).otherwise(1.0)
    sums = marked.groupBy("week").agg(
        total(now, F.col("stake")).alias("gross"), total(now, heavy).alias("effective_gross"),
        total(~now, F.col("stake")).alias("prior"), total(~now, heavy).alias("effective_prior"),
        F.coalesce(F.sum(F.when(now, F.col("n_bets"))), F.lit(0)).alias("n_bets"),
        F.count_if(now).alias("n_matches"), F.count_if(now & tie).alias("n_correlated"),
    )
    budget = F.greatest(F.lit(0.0), cap - F.col("effective_prior"))
    fits = F.col("effective_gross") <= F.col("budget") * (1.0 + K.EXPOSURE_TOLERANCE)
    factor = F.when(fits, 1.0).otherwise(F.col("budget") / F.col("effective_gross"))
    state = (
        F.when((F.col("factor") <= 0) & (F.col("n_bets") > 0), "blocked")
        .when(F.col("factor") < 1, "reduced")
        .when(F.col("total") > cap * (1.0 + K.EXPOSURE_TOLERANCE), "already_above_cap")
        .otherwise("under_cap")
    )
    return (
        sums.withColumn("budget", budget).withColumn("factor", factor)
        .withColumn("net", F.col("gross") * F.col("factor"))
        .withColumn("total", F.col("prior") + F.col("net")).withColumn("state", state)
    )


def final_stakes(stakes: DataFrame, factors: DataFrame) -> DataFrame:
    """Stakes times the week's factor; what rounds to zero drops out, cut bets keep the uncapped stake."""
    out = stakes.join(factors.select("week", "factor"), "week")
    cut = F.col("factor") < 1
    return out.withColumn("stake_pct", F.round(F.col("stake") * F.col("factor"), 6)).filter("stake_pct > 0").withColumns({
        "stake_pct_uncapped": F.when(cut, F.round("stake", 6)), "exposure_factor": F.when(cut, F.round("factor", 6)),
    }).drop("stake", "factor")


def bet_lists(final: DataFrame, by: Sequence[str]) -> DataFrame:
    """The bets of each match as an array (three at most, in outcome order)."""
    pick = lambda i: F.first(F.when(F.col("issue") == i, F.struct("issue", "odds", "stake_pct", "stake_pct_uncapped", "exposure_factor")), ignorenulls=True)
    each = final.groupBy(*by).agg(*[pick(i).alias(f"_{i}") for i in K.ISSUES])
    return each.select(*by, F.filter(F.array(*[F.col(f"_{i}") for i in K.ISSUES]), lambda b: b.isNotNull()).alias("bets"))


def coupon(bets: DataFrame, flags: DataFrame, low_history: Sequence[str], stale_days: int = K.STALE_MIN_DAYS) -> DataFrame:
    """Open bets with every reason against them; an empty list means the bet stays.

    ``bets``: match, home, away, issue, odds, stake_pct, odds_age_days. ``flags``: one row per match
    with the context booleans; a match without a row has no flags.
    """
    out = bets.join(flags, "match", "left")
    flag = lambda n: F.coalesce(F.col(n), F.lit(False)) if n in out.columns else F.lit(False)
    low = F.col("home").isin(list(low_history)) | F.col("away").isin(list(low_history))
    tests: list[tuple[Column, str]] = [(low, "low_history"), (F.col("odds_age_days") >= stale_days, "stale_odds")]
    tests += [(flag(a) | flag(b), name) for a, b, name in CONTEXT_RULES]
    tests.append((flag("derby") & (F.col("odds") > K.DERBY_ODDS), "derby_outsider"))
    reasons = F.filter(F.array(*[F.when(t, F.lit(n)) for t, n in tests]), lambda r: r.isNotNull())
    return out.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)


def undocumented(bets: DataFrame, flags: DataFrame) -> DataFrame:
    return bets.select("match").distinct().join(flags.select("match"), "match", "left_anti")


def without_odds_summary(fixtures: DataFrame) -> DataFrame:
    """Fixtures that ran without odds, counted by reason, with the first and last date."""
    return fixtures.filter("market IS NULL").groupBy("no_odds_reason").agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )
