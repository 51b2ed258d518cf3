"""Operators of a training-data pipeline: filters, deduplication, scans and packing over text tables."""
