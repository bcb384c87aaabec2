"""Operators for text corpora: fingerprints, filters, deduplication, tokens and packing."""
