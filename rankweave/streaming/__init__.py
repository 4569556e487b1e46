"""Ingestion driven by Structured Streaming."""
