"""Operators for training-data pipelines: filters, extraction, near duplicates, search, tokens, packing, archives."""
