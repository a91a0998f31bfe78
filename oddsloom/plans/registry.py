"""Query registry: name -> DataFrame function, with an optional SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import release_kept
from ..views import Tables, with_views

FAMILIES = (
    "ingest", "merging", "joining", "pricing", "goals", "featuring", "learning",
    "scoring", "resampling", "tuning", "studying", "staking", "settling", "checking", "streaming", "proving",
)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            release_kept()  # caches of the query before
            return fn(Tables(spark, folder))

        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if oracle is not None:
            _ORACLES[name] = with_views(oracle)
        return fn

    return wrap


def _load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"{__package__}.{family}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
