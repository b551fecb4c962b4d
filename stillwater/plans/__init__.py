"""Registered queries over the driver's tables, each beside its SQL."""

from stillwater.plans import catalog, color, frames, fusion, proposals, rules, timeline, vectors, workflow
from stillwater.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog", "color", "frames", "fusion", "proposals", "rules", "timeline", "vectors", "workflow"]
