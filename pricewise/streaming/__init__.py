"""Incremental ingest of price uploads with Structured Streaming."""
