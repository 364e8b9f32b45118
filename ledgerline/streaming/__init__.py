"""Incremental keyed merge on Structured Streaming."""
