"""Structured Streaming jobs (STR-1, STR-2)."""
