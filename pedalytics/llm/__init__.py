"""Operators of a training-data pipeline (sharding, deduplication, packing, scoring, mixing)."""
