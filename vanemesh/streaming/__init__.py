"""Structured Streaming forms of ingest, rollups and profiles."""
