"""Operators for large training-text pipelines: search, cleaning, near-duplicates, extraction,
mixing, archives, sharding, packing, scoring. Nothing outside this folder imports it."""
