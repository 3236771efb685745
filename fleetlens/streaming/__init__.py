"""Structured Streaming jobs over landed snapshot files."""
