"""Cell cleaning and fallback chains (Column functions)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """Lenient cast: text that is not a number, or NaN, becomes NULL."""
    value = c.try_cast("double")
    return F.when(F.isnan(value), None).otherwise(value)


def all_present(cells: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x & y, [c.isNotNull() for c in cells])


def first_complete(
    groups: Sequence[Sequence[Column]], names: Sequence[str], tags: Sequence[str] | None = None
) -> Column:
    """Struct of the first group whose cells are all present, optionally tagged with its source."""
    options = []
    for i, cells in enumerate(groups):
        fields = [c.alias(n) for c, n in zip(cells, names)]
        if tags is not None:
            fields.append(F.lit(tags[i]).alias("source"))
        options.append(F.when(all_present(cells), F.struct(*fields)))
    return F.coalesce(*options)


def first_quoted(groups: Sequence[Sequence[Column]], names: Sequence[str]) -> Column:
    """As ``first_complete``, but a zero quote counts as missing."""
    return first_complete([[F.when(c != 0, c) for c in g] for g in groups], names)
