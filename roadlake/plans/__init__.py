"""Named queries by subject; importing the modules registers them."""

from roadlake.plans import contexts, details, evidence, grids, queries, questions, stores, zones
from roadlake.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "contexts", "details", "evidence", "grids", "queries", "questions", "stores", "zones"]
