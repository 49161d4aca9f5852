"""Structured Streaming runners of the flows."""
