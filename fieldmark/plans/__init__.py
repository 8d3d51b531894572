"""Queries over the driver's tables, each with the same query as SQL where SQL can state it."""

from __future__ import annotations

from fieldmark.plans import agreement, data, fitting, selection, survey
from fieldmark.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "agreement", "data", "fitting", "selection", "survey"]
