"""Structured Streaming over events as they arrive."""
