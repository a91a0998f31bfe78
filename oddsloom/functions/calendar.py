"""Season, week and age columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def season_start(d: Column) -> Column:
    """Calendar year in which the season of ``d`` started; the switch is in July."""
    return F.year(d) - F.when(F.month(d) >= 7, 0).otherwise(1)


def season_code(d: Column) -> Column:
    """Four-digit code such as 2324."""
    start = season_start(d)
    two = lambda y: F.lpad((y % 100).cast("string"), 2, "0")
    return F.concat(two(start), two(start + 1))


def monday(d: Column) -> Column:
    return F.date_trunc("week", d).cast("date")


def next_saturday(d: Column) -> Column:
    """The coming Saturday, ``d`` itself when it is one."""
    return F.next_day(F.date_sub(d, 1), "Sat")


def age_days(kickoff: Column, priced_on: Column) -> Column:
    """Whole days between quote and kick-off, never negative; NULL when the quote date is unknown."""
    days = F.datediff(kickoff, priced_on)
    return F.when(days.isNotNull(), F.greatest(F.lit(0), days))


def mixed_date(text: Column) -> Column:
    """Day-first date with a two- or four-digit year; two digits from 69 on mean the 1900s.

    Only the one format that a text's shape allows is tried: a failed attempt costs far more than a parse. ``dd/MM/yy`` takes
    eight characters and the others ten or more, and only a day-first text has its third character a slash.
    """
    short = F.try_to_timestamp(text, F.lit("dd/MM/yy"))
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200).cast("timestamp")).otherwise(short)
    long = F.try_to_timestamp(text, F.lit("dd/MM/yyyy"))
    iso = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    return F.when(F.length(text) == 8, short).when(F.substring(text, 3, 1) == "/", long).otherwise(iso).cast("date")
