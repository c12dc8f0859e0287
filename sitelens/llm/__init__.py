"""Operators for building training corpora: cleaning, deduplication, mixing, packing, scoring and search."""
