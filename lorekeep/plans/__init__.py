"""The query catalogue over the driver tables, each query with its SQL."""

from lorekeep.plans import captures, graphs, searches, stores, streams  # noqa: F401  they register their queries
from lorekeep.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
