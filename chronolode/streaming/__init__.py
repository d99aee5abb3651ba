"""Incremental ingest."""

from .ingest import ingest_chunks, landed_commits, landed_rejects

__all__ = ["ingest_chunks", "landed_commits", "landed_rejects"]
