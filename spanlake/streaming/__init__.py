"""Structured Streaming: ingest into a store, and running state."""
