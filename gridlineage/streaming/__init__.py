"""Structured Streaming over drop folders."""
