"""Streaming counterparts of deduplication, rollups and call matching."""
