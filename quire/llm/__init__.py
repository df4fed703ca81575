"""Operators for building training data: scoring, scanning, packing, classification, deduplication.

Nothing outside this package imports it.
"""
