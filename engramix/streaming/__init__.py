"""Structured Streaming: episode ingestion, fatigue counts per session, the index queue's worker."""
