"""Operators of a training-data pipeline: duplicates, quality, mixing, formats, shards."""
