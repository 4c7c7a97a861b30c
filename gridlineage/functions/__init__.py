"""Column functions: references, values, text."""
