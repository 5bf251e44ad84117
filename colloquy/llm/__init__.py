"""Operators of a training-data pipeline: tokenising, filtering, deduplication, packing, search."""
