"""Operators of a training-data pipeline: scoring, de-duplication, sharding, media, packing.

Nothing else in the library imports this subpackage.
"""
