"""Structured Streaming versions of ingest, load counts and active-device state."""
