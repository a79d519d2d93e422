"""Queries over the driver's tables; importing the modules registers them."""

from meridial.plans import analytics, catalogue, complete, links, profiles, programs, recommend, screens, selection, tables
from meridial.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analytics", "catalogue", "complete", "links", "profiles", "programs", "recommend", "screens", "selection", "tables"]
