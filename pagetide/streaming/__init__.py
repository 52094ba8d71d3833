"""Structured Streaming forms of ingestion and attempt draining."""
