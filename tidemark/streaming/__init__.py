"""Structured Streaming forms of the cursor feed and of change capture."""
