"""Lineage and recalculation of spreadsheet-shaped data on Spark."""

from .plans.lineage import Lineage, analyze

__all__ = ["Lineage", "analyze"]
