"""Structured Streaming jobs over landed snapshots and readings."""
