"""Structured Streaming ingest of log events."""
