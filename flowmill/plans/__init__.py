"""Registered queries over the given tables."""

from flowmill.plans import encoding, feed, live, matching, panels, research  # noqa: F401
from flowmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
