"""Structured Streaming over labelled events."""
