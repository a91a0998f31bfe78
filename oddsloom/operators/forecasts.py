"""From strengths to forecasts: walk-forward predictions, lineups, fixture scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import grid as G
from ..functions import odds as O
from ..functions.markets import handicap_covered, market_hit, market_prob
from ..functions.outcomes import outcome_index
from ..session import keep
from .baselines import market_frequencies, outcome_frequencies, with_week
from .joins import expected_goals, with_strengths
from .strengths import SETTING, Setting, fit_all, grid_settings, target_folds

BY = ["league", "week"]


def predict(fixtures: DataFrame, strengths: DataFrame, by: Sequence[str] = (*BY, *SETTING)) -> DataFrame:
    """Adds lam_h, lam_a, rho and the 7 x 7 outcome triple ``model`` per fixture and setting."""
    small = keep(strengths)
    keyed = [c for c in by if c in fixtures.columns]
    rows = fixtures
    if len(keyed) < len(by):  # the settings come from the strengths: one row per setting
        combos = small.select(*by).distinct()
        rows = fixtures.join(combos, keyed)
    rates = expected_goals(with_strengths(rows, small, list(by)))
    grid = G.score_grid(F.col("lam_h"), F.col("lam_a"), F.col("rho"))
    probs = F.transform(F.array(grid), lambda g: G.outcome_probs(g))[0]
    drop = ["attack_h", "attack_a", "defence_h", "defence_a", "attack_mean", "defence_mean", "home_edge"]
    return rates.drop(*drop).withColumn("model", probs)


def walk_forward(played: DataFrame, seasons: Sequence, settings: Sequence[Setting]) -> DataFrame:
    """Weekly refit on everything before each Monday; one row per target match and setting."""
    strengths = fit_all(played, target_folds(played, seasons), settings)
    target = with_week(played.filter(F.col("season").isin(list(seasons))))
    rows = predict(target, strengths)
    return rows.withColumn("outcome", outcome_index(F.col("fthg"), F.col("ftag")))


def score_season_set(
    played: DataFrame, seasons: Sequence, xi: float, w: float = 0.0, kappa: float = K.KAPPA_DEFAULT,
    temperature: float | None = None,
) -> DataFrame:
    """Frozen settings over the test seasons: model (calibrated), raw, market and frequency triples."""
    preds = walk_forward(played, seasons, grid_settings([xi], [w], [kappa]))
    freq = keep(outcome_frequencies(played))
    odds = F.array("odds_h", "odds_d", "odds_a")
    raw = F.col("model")
    return (
        preds.join(freq, BY)
        .withColumn("market", O.fair(odds, "power"))
        .withColumn("raw", raw)
        .withColumn("model", O.temper(raw, F.lit(temperature)) if temperature is not None else raw)
    )


def derived_rows(preds: DataFrame, frequencies: DataFrame, temperatures: dict[str, float] | None = None) -> DataFrame:
    """Long rows (match_id, market, raw_p, model_p, market_p, freq_p, y) of the derived markets.

    Handicap pushes and missing lines are left out; a market probability needs both prices.
    ``preds`` has lam_h, lam_a, rho, fthg, ftag, ah_line and, where quoted, ou25_* and ah_* odds.
    """
    grids = {
        g: G.score_grid(F.col("lam_h"), F.col("lam_a"), F.col("rho"), g) for g in (K.GRID_GOALS, K.WIDE_GRID_GOALS)
    }
    rows = preds.withColumns({"_g6": grids[K.GRID_GOALS], "_g11": grids[K.WIDE_GRID_GOALS]})
    have = {K.GRID_GOALS: F.col("_g6"), K.WIDE_GRID_GOALS: F.col("_g11")}
    price = lambda c: F.col(c) if c in preds.columns else F.lit(None).cast("double")
    missing = F.lit(None).cast("double")
    quoted = {"ou25": O.fair_two_way(price("ou25_over"), price("ou25_under"))}
    items = [
        F.struct(
            F.lit(m).alias("market"), market_prob(m, have).alias("raw_p"),
            quoted.get(m, missing).alias("market_p"),
            market_hit(m, F.col("fthg"), F.col("ftag")).alias("y"),
        )
        for m in K.DERIVED_MARKETS
    ]
    items.append(
        F.struct(
            F.lit(K.HANDICAP_MARKET).alias("market"),
            G.handicap_conditional(F.col("_g11"), K.WIDE_GRID_GOALS, F.col("ah_line")).alias("raw_p"),
            O.fair_two_way(price("ah_home"), price("ah_away")).alias("market_p"),
            handicap_covered(F.col("fthg"), F.col("ftag"), F.col("ah_line")).alias("y"),
        )
    )
    long = (
        rows.select("match_id", "league", "season", "week", F.inline(F.array(*items)))
        .filter("y IS NOT NULL")
        .join(keep(frequencies), ["league", "week", "market"], "left")
        .withColumn("freq_p", F.coalesce("freq", F.lit(0.5)))
        .drop("freq")
    )
    return with_calibrated(long, temperatures)


def with_calibrated(long: DataFrame, temperatures: dict[str, float] | None) -> DataFrame:
    """Frozen temperature per market when there is one, else the raw probability; flagged."""
    known = temperatures or {}
    pairs = [v for m, t in known.items() for v in (F.lit(m), F.lit(float(t)))]
    t = F.try_element_at(F.create_map(*pairs), F.col("market")) if pairs else F.lit(None).cast("double")
    return (
        long.withColumn("_t", t)
        .withColumn("calibrated", F.col("_t").isNotNull())
        .withColumn("model_p", F.when(F.col("_t").isNull(), F.col("raw_p")).otherwise(O.temper_binary(F.col("raw_p"), F.col("_t"))))
        .drop("_t")
    )


def derived_season_set(
    played: DataFrame, seasons: Sequence, xi: float, w: float, kappa: float,
    temperatures: dict[str, float] | None = None,
) -> DataFrame:
    preds = walk_forward(played, seasons, grid_settings([xi], [w], [kappa]))
    return derived_rows(preds, market_frequencies(played), temperatures)


def lineup_ratios(entries: DataFrame) -> DataFrame:
    """(match_id, side, axis, ratio) from long lineup values with role confirmed or reference.

    Sum of confirmed over sum of reference, clamped; an empty reference leaves 1.
    """
    part = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.col("value"))), F.lit(0.0))
    sums = entries.groupBy("match_id", "side", "axis").agg(part("confirmed").alias("c"), part("reference").alias("r"))
    ratio = F.when(F.col("r") <= 0, 1.0).otherwise(
        F.greatest(F.lit(K.LINEUP_MIN), F.least(F.lit(K.LINEUP_MAX), F.col("c") / F.col("r")))
    )
    return sums.select("match_id", "side", "axis", ratio.alias("ratio"))


def apply_lineups(fixtures: DataFrame, entries: DataFrame) -> DataFrame:
    """Own attack scales the own rate, own defence the opponent's; strong axes are listed."""
    axes = [(s, x) for s in ("home", "away") for x in ("attack", "defense")]
    pick = [
        F.max(F.when((F.col("side") == s) & (F.col("axis") == x), F.col("ratio"))).alias(f"{s}_{x}") for s, x in axes
    ]
    wide = lineup_ratios(entries).groupBy("match_id").agg(*pick)
    out = fixtures.join(wide, "match_id", "left").withColumn(
        "lineup_applied", F.coalesce(*[F.col(f"{s}_{x}") for s, x in axes]).isNotNull()
    )
    one = {f"{s}_{x}": F.coalesce(f"{s}_{x}", F.lit(1.0)) for s, x in axes}
    strong = F.filter(
        F.array(*[F.struct(F.lit(f"{s}/{x}").alias("axis"), F.col(f"{s}_{x}").alias("r")) for s, x in axes]),
        lambda e: F.abs(e["r"] - 1.0) > K.LINEUP_ALERT,
    )
    return out.withColumns(one).withColumns({
        "lam_h_before": F.col("lam_h"), "lam_a_before": F.col("lam_a"),
        "lam_h": F.col("lam_h") * F.col("home_attack") * F.col("away_defense"),
        "lam_a": F.col("lam_a") * F.col("away_attack") * F.col("home_defense"),
        "strong_axes": F.transform(strong, lambda e: e["axis"]),
    })


def consensus(quotes: DataFrame, by: Sequence[str], method: str = "shin") -> DataFrame:
    """Market triple per fixture: every book de-margined on its own, then averaged; best raw prices.

    ``quotes``: by + odds_h, odds_d, odds_a, one row per book.
    """
    odds = F.array("odds_h", "odds_d", "odds_a")
    fair = quotes.filter(O.quoted(odds)).select(*by, "odds_h", "odds_d", "odds_a", O.fair(odds, method).alias("_p"), O.margin_ok(odds).alias("_ok"))
    return (
        fair.groupBy(*by)
        .agg(
            *[F.avg(F.col("_p")[k]).alias(f"_m{k}") for k in range(3)],
            *[F.max(c).alias(f"_b{k}") for k, c in enumerate(("odds_h", "odds_d", "odds_a"))],
            F.count("*").alias("n_books"), F.bool_and("_ok").alias("margins_ok"),
        )
        .select(
            *by, F.array("_m0", "_m1", "_m2").alias("market"), F.array("_b0", "_b1", "_b2").alias("best_odds"),
            "n_books", "margins_ok",
        )
    )


def final_probs(df: DataFrame, base: float = K.BASE_BLEND) -> DataFrame:
    """Freshness-weighted blend of ``market`` and ``model``; without a market the weight is 0."""
    weight = F.when(
        F.col("market").isNotNull(), O.freshness_weight(F.col("odds_age_days"), F.coalesce("margins_ok", F.lit(True)), base)
    ).otherwise(0.0)
    return df.withColumn("market_weight", weight).withColumn(
        "final", O.blend(F.col("market"), F.col("model"), F.col("market_weight"))
    )


def score_fixtures(
    fixtures: DataFrame, played: DataFrame, quotes: DataFrame, xi: float, w: float, kappa: float,
    temperature: float, lineups: DataFrame | None = None,
) -> DataFrame:
    """Every fixture of a table at once: refit before its Monday, lineup, calibrate, blend.

    ``fixtures``: match_id, league, date, home, away, odds_age_days. ``quotes``: match_id and one
    odds triple per book.
    """
    dated = with_week(fixtures)
    folds = dated.select("league", "week").distinct()
    settings = grid_settings([xi], [w], [kappa])
    strengths = keep(fit_all(played, folds, settings))
    rates = expected_goals(with_strengths(dated, strengths, BY))
    if lineups is not None:
        rates = apply_lineups(rates, lineups)
    g6 = G.score_grid(F.col("lam_h"), F.col("lam_a"), F.col("rho"))
    g11 = G.score_grid(F.col("lam_h"), F.col("lam_a"), F.col("rho"), K.WIDE_GRID_GOALS)
    scored = rates.withColumns({"grid": g6, "grid_wide": g11}).withColumn("raw", G.outcome_probs(F.col("grid")))
    scored = scored.withColumn("model", O.temper(F.col("raw"), F.lit(temperature)))
    priced = scored.join(consensus(quotes, ["match_id"]), "match_id", "left")
    return final_probs(priced)


def contest_points(df: DataFrame, points: dict[str, float], bonus: float) -> DataFrame:
    """Expected points per outcome, the best pick, and how it compares with the favourite.

    Needs ``grid`` (7 x 7) and ``final``.
    """
    best = {i: G.best_score_by_outcome(F.col("grid"), K.GRID_GOALS, i).alias(f"_best_{i}") for i in K.ISSUES}
    options = [
        F.struct(
            (points[i] * F.col("final")[k] + bonus * F.col(f"_best_{i}.p")).alias("ep"), F.lit(-k).alias("o"),
            F.lit(i).alias("issue"), F.concat_ws("-", f"_best_{i}.h", f"_best_{i}.a").alias("score"),
        )
        for k, i in enumerate(K.ISSUES)
    ]
    packed = df.select("*", *best.values()).withColumn("_opts", F.array(*options)).drop(*[f"_best_{i}" for i in K.ISSUES])
    packed = packed.withColumn("_pick", F.array_max("_opts"))
    fav = F.array_position("final", F.array_max("final"))
    return packed.withColumns({
        "pick": F.col("_pick.issue"), "pick_score": F.col("_pick.score"), "pick_points": F.col("_pick.ep"),
        "favourite": F.element_at(F.array(*[F.lit(i) for i in K.ISSUES]), fav.cast("int")),
        "favourite_points": F.element_at("_opts", fav.cast("int"))["ep"],
    }).drop("_opts", "_pick")


def triple_columns(df: DataFrame, name: str, digits: int = 6) -> list[Column]:
    return [F.round(F.col(name)[k], digits).alias(f"{name}_{s}") for k, s in enumerate("hda")]
