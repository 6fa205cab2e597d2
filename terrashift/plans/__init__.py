"""Plans: the operators put together on the test tables, each with its SQL."""

from terrashift.plans import regions, relations, scalars, timeseries  # noqa: F401
from terrashift.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
