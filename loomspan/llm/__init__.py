"""Operators of a training-data pipeline: deduplication, licences, sharding, search, fixity, quality, mixing and tokens."""
