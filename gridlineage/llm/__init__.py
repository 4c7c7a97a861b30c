"""Operators for preparing training corpora: sharding, scoring, deduplication, packing, encoding."""
