"""Operators of a training-data pipeline: packing, scoring, joins, mixing, deduplication, cleaning and archives.

``queries()`` and ``oracles()`` list the registered queries of this subpackage.
"""

from .plans import oracles, queries

__all__ = ["queries", "oracles"]
