"""Queries over the operators; importing this package registers all of them."""

from gridmetric.plans import analytics, relations, runs, scalars, tiles  # noqa: F401
from gridmetric.plans.registry import ORACLES, QUERIES  # noqa: F401
