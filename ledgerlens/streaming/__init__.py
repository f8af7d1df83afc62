"""Incremental upkeep of rollups with Structured Streaming."""
