"""Corpus operators for training data: scoring, deduplication, mixing, filtering and packing.

Nothing else in ``fitloom`` imports this subpackage.
"""
