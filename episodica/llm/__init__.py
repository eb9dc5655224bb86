"""Operators for large training-data pipelines: near and exact deduplication, scans, sharding, tokens, archives."""
