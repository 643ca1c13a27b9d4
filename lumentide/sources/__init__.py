"""Readers of tables, images and listings, and writers that never overwrite."""
