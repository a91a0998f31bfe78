"""Components of a similarity join whose candidates are lists of nodes, without pairing whole lists.

Two nodes are candidates when a list holds both. Testing all pairs of a list grows with its square, and a group of
near copies makes long lists whose pairs nearly all end in one component. So first each list's members are tested
against its hub alone, the member of most weight, and the links joined to components; what remains is tested against
a second hub; then every pair that still shares a list but no component is tested. Every pair left out lies within
one component, so the components are those of all links. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import settled

STARS = 2
Fits = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def open_lists(lists: DataFrame, label: DataFrame | None) -> DataFrame:
    """Entries with their component, of the lists that hold two components or more."""
    if label is None:
        rows = lists.withColumn("comp", F.col("node"))
    else:
        rows = lists.join(label, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    several = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    return rows.join(settled(several, "open-lists"), "key")


def all_pairs(now: DataFrame, own: list[str], fits: Fits) -> DataFrame:
    """Pairs of a list whose components differ."""
    x, y = (now.select("key", F.struct("node", "comp", *own).alias(side)) for side in ("x", "y"))
    near = x.join(y, "key").filter("x.node < y.node and x.comp <> y.comp")
    near = near.filter(fits(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")))
    return near.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def connect(
    lists: DataFrame,
    fits: Fits,
    verify: Callable[[DataFrame], DataFrame],
    refine: Callable[[DataFrame], tuple[DataFrame, Fits]] | None = None,
    links: DataFrame | None = None,
) -> DataFrame:
    """(node, component) of all linked nodes. ``lists``: key, node, weight (longs) and the columns that ``fits`` asks
    of two entries before a pair is tested; ``verify`` gives those of its pairs (a, b) that link. ``refine`` makes
    other lists, and their test, of the entries that the hubs leave open; without it all their pairs are tested.
    ``links`` are known beforehand."""
    own = [c for c in lists.columns if c not in ("key", "node", "weight")]
    label = None if links is None else settled(components(links), "labels")
    for turn in range(STARS + 1):
        now = open_lists(lists, label)
        if turn < STARS:
            hubs = now.groupBy("key").agg(F.max(F.struct("weight", "node", "comp", *own)).alias("hub"))
            hubs = settled(hubs, "hubs")  # a table of its own, so that Spark can split a join with a long list
            now = settled(now.join(hubs, "key").filter("node <> hub.node"), "lists")
            lists = now.drop("hub", "comp")  # the hub has met them all
            near = now.filter("comp <> hub.comp").filter(fits(lambda c: F.col(f"hub.{c}"), F.col))
            pairs = near.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
        else:
            now = settled(now, "lists")
            if now.isEmpty():
                break
            if refine is not None:
                return connect(*refine(now), verify, links=links)
            pairs = all_pairs(now, own, fits)
        found = verify(pairs)
        if links is None or not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            label = settled(components(links), "labels")
    return label
