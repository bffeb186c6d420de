"""Operators for preparing training data: scoring, filtering, deduplication, mixing and packing of documents."""
