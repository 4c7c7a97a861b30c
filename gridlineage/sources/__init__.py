"""Readers of workbooks and of tables laid out as sheets."""
