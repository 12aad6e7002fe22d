"""Structured Streaming ingestion and stream-static search."""
