"""Batch operators: beacons, deduplication, attribution, reports, health, erasure."""
