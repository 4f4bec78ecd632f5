"""Incremental ingest: batch update and Structured Streaming."""
