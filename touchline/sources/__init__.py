"""Readers, writers and the adapters for the shared test tables."""
