"""Imports every module that registers queries."""

from framewright.plans import duplicates, formats, fusion, labels, operations, points, scenes, streams  # noqa: F401
from framewright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
