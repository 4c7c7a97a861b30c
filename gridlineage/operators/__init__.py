"""Lineage operators on DataFrames."""
