"""Append logs: as tables, and as Structured Streaming queries."""
