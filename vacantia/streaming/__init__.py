"""Incremental forms of ingest and merge on Structured Streaming."""
