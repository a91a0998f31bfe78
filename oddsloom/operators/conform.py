"""Name conformance, match keys, intake checks and the two-sided view of a match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DECLARABLE_REASONS, DEFAULT_REASON, TOP_LEAGUES
from ..session import keep


def teams_of(matches: DataFrame) -> DataFrame:
    """Distinct (league, team) over both sides."""
    return (
        matches.select("league", F.explode(F.array("home", "away")).alias("team"))
        .distinct()
    )


def resolve_aliases(rows: DataFrame, names: Sequence[str], aliases: DataFrame, teams: DataFrame) -> DataFrame:
    """Canonical name per column, plus ``<name>_known``: does the league know it?

    Names without an alias pass through. Both lookups are dimension tables, broadcast when their
    counted size allows it.
    """
    small_aliases, small_teams = keep(aliases), keep(teams)
    out = rows
    for name in names:
        a = small_aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
        t = small_teams.select(F.col("league").alias("_league"), F.col("team").alias("_team"))
        out = (
            out.join(a, F.col(name) == F.col("_alias"), "left")
            .withColumn(name, F.coalesce("_canonical", name))
            .join(t, (F.col("league") == F.col("_league")) & (F.col(name) == F.col("_team")), "left")
            .withColumn(f"{name}_known", F.col("_team").isNotNull())
            .drop("_alias", "_canonical", "_league", "_team")
        )
    return out


def unresolved_names(resolved: DataFrame, names: Sequence[str]) -> DataFrame:
    packed = F.array(*[F.struct(F.col(n).alias("name"), F.col(f"{n}_known").alias("known")) for n in names])
    return resolved.select("league", F.inline(packed)).filter("NOT known").select("league", "name").distinct()


def _staged(name: Column, teams: Column, alias: Column) -> Column:
    """Struct (team, stage) of the first stage that settles the name, else NULL."""
    low = F.lower(F.trim(name))
    same = F.filter(teams, lambda t: F.lower(t) == low)
    part = F.filter(teams, lambda t: F.lower(t).contains(low) | low.contains(F.lower(t)))
    pick = lambda team, stage: F.struct(team.alias("team"), F.lit(stage).alias("stage"))
    return (
        F.when(F.array_contains(teams, name), pick(name, 1))
        .when(F.array_contains(teams, alias), pick(alias, 2))
        .when(F.size(same) == 1, pick(F.get(same, F.lit(0)), 3))
        .when(F.size(part) == 1, pick(F.get(part, F.lit(0)), 4))
    )


def resolve_names(names: DataFrame, teams: DataFrame, aliases: DataFrame, column: str = "name") -> DataFrame:
    """Staged match of (league, name): exact, alias, unique case-insensitive, unique substring.

    Adds team, stage (0 = unresolved, the name itself comes back). Each distinct name is resolved
    once against its league's team list, an equi-join instead of a substring nested loop.
    """
    lists = keep(teams.groupBy("league").agg(F.collect_set("team").alias("_teams")))
    lookup = keep(aliases.select(F.col("alias").alias("_a"), F.col("canonical").alias("_alias")))
    distinct = names.select("league", F.col(column).alias("_name")).distinct()
    settled = (
        distinct.join(lists, "league", "left")
        .join(lookup, F.col("_name") == F.col("_a"), "left")
        .withColumn("_r", _staged(F.col("_name"), F.col("_teams"), F.col("_alias")))
        .select(
            F.col("league").alias("_l"), "_name",
            F.coalesce(F.col("_r.team"), F.col("_name")).alias("team"),
            F.coalesce(F.col("_r.stage"), F.lit(0)).alias("stage"),
        )
    )
    on = (F.col("league") == F.col("_l")) & (F.col(column) == F.col("_name"))
    return names.join(settled, on, "left").drop("_l", "_name")


def split_match_keys(keys: DataFrame, teams: DataFrame, aliases: DataFrame) -> DataFrame:
    """(league, match, home, away) for keys with exactly one split at '-' whose halves both resolve
    to different teams; other keys are absent."""
    distinct = keys.select("league", "match").distinct()
    parts = F.split("match", "-")
    cut = F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(
        F.array_join(F.slice(parts, F.lit(1), i), "-").alias("left"),
        F.array_join(F.slice(parts, i + 1, F.size(parts) - i), "-").alias("right"),
    )))
    splits = (
        distinct.filter(F.size(parts) > 1).select("league", "match", cut.alias("_i", "_s"))
        .select("league", "match", "_i", F.col("_s.left").alias("left"), F.col("_s.right").alias("right"))
        .filter("left <> '' AND right <> ''")
    )
    homes = resolve_names(splits, teams, aliases, "left").withColumnsRenamed({"team": "home", "stage": "_hs"})
    both = resolve_names(homes, teams, aliases, "right").withColumnsRenamed({"team": "away", "stage": "_as"})
    good = both.filter("_hs > 0 AND _as > 0 AND home <> away")
    return (
        good.groupBy("league", "match")
        .agg(F.count("*").alias("_n"), F.min(F.struct("home", "away")).alias("_p"))
        .filter("_n = 1")
        .select("league", "match", F.col("_p.home").alias("home"), F.col("_p.away").alias("away"))
    )


def intake_checks(fixtures: DataFrame, leagues: Sequence[str] = TOP_LEAGUES) -> DataFrame:
    """Adds ``error`` (NULL when the row is fine) and the effective ``no_odds_reason``.

    Needs league, home, away, odds_home, odds_draw, odds_away as text, and no_odds_reason.
    """
    raw = [F.col(f"odds_{s}") for s in ("home", "draw", "away")]
    given = raw[0].isNotNull() | raw[1].isNotNull() | raw[2].isNotNull()
    numeric = F.lit(True)
    for c in raw:
        numeric = numeric & c.try_cast("double").isNotNull()
    declared = F.col("no_odds_reason")
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    error = (
        F.when(F.col("league").isNull() | ~F.col("league").isin(list(leagues)), "unknown_league")
        .when(blank("home") | blank("away"), "missing_team")
        .when(given & ~numeric, "odds_not_numeric")
        .when(declared.isNotNull() & ~declared.isin(list(DECLARABLE_REASONS)), "undeclarable_reason")
    )
    return fixtures.withColumn("error", error).withColumn(
        "no_odds_reason", F.when(~given, F.coalesce(declared, F.lit(DEFAULT_REASON)))
    )


def sides(matches: DataFrame, keep: Sequence[str], swap: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Two rows per match, one per team: keep + (team, opponent, is_home) + paired statistics.

    ``swap`` lists (name, home column, away column): ``<name>f`` is the team's own value and
    ``<name>a`` the opponent's.
    """
    def row(is_home: bool) -> Column:
        fields = [
            F.col("home" if is_home else "away").alias("team"),
            F.col("away" if is_home else "home").alias("opponent"),
            F.lit(is_home).alias("is_home"),
        ]
        for name, h, a in swap:
            own, other = (h, a) if is_home else (a, h)
            fields += [F.col(own).alias(f"{name}f"), F.col(other).alias(f"{name}a")]
        return F.struct(*fields)

    return matches.select(*keep, F.inline(F.array(row(True), row(False))))
