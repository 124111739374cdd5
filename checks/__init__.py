"""Operators bound to the driver tables, with their SQL."""

from checks import feeds, rules  # noqa: F401  (they register their queries)
from checks.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
