"""Structured Streaming variants of the in-play operators."""
