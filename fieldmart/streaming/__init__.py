"""Structured Streaming variants of ingest, deduplication, metrics and upsert."""
