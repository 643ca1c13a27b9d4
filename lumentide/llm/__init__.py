"""Operators for large text corpora: sharding, extraction, fingerprints, filters, joins, packing, tokens."""
