"""Operators of a training-data pipeline: packing, mixing, scoring, deduplication, archives."""
